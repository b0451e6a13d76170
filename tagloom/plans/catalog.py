"""Registered queries: each operator over the derived views, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import geometry as geo
from tagloom.functions import qr, text
from tagloom.operators import candidates, detection, export, frames, labels, nms, pixels, tiles, tracking
from tagloom.plans import fixtures as fx
from tagloom.schema import EXPORT_COLUMNS
from tagloom.sources import catalog as products
from tagloom import config

Query = Callable[[SparkSession, str], DataFrame]
_ENTRIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _ENTRIES[name] = (f, sql)
        return f

    return register


def over(name: str, statement: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], object]:
    """Register a function of one derived view; the SQL sees that view as ``src``."""

    def register(f: Callable[[DataFrame], DataFrame]) -> object:
        full = None if sql is None else sql if sql.lstrip().startswith("with recursive") else f"with src as ({statement}) {sql}"
        _ENTRIES[name] = ((lambda spark, sf_dir: f(fx.view(spark, sf_dir, statement))), full)
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name or "v")


def iou_sql(a: str, b: str) -> str:
    common = f"(greatest(cast(0 as double), least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(cast(0 as double), least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"
    return f"({common} / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {common} + cast(1e-6 as double)))"


# ---- geometry

_PAIR = f"""
select a.det_id as det_id, a.frame_id as frame_id, a.x1 as x1, a.y1 as y1, a.x2 as x2, a.y2 as y2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2
from ({fx.DET}) a join ({fx.DET}) b on a.frame_id = b.frame_id and b.det_ord = a.det_ord + 4
"""
_CD = "(sqrt(power((x1 + x2) / 2 - (bx1 + bx2) / 2, 2) + power((y1 + y2) / 2 - (by1 + by2) / 2, 2)) / ((x2 - x1 + y2 - y1 + bx2 - bx1 + by2 - by1) / 4 + cast(1e-6 as double)))"
_AR = "(least((x2 - x1) * (y2 - y1), (bx2 - bx1) * (by2 - by1)) / (greatest((x2 - x1) * (y2 - y1), (bx2 - bx1) * (by2 - by1)) + cast(1e-6 as double)))"
for _name, _column, _sql in (
    ("iou", lambda a, b: geo.iou(a, b), iou_sql("", "b")),
    ("center_distance", lambda a, b: geo.center_distance(a, b), _CD),
    ("area_ratio", lambda a, b: geo.area_ratio(a, b), _AR),
    ("match_score", lambda a, b: geo.match_score(a, b, 0.4, 0.5), f"case when {_CD} > 0.4 or {_AR} < 0.5 then -1 else {_AR} * (1 - {_CD} / cast(0.4 as double)) end"),
):
    over(_name, _PAIR, f"select det_id, round(cast({_sql} as double), 6) + 0.0 as v from src")(lambda df, c=_column: df.select("det_id", r6(c(geo.box(), geo.box("b")))))


@over("expand_crop", f"select d.det_id, d.x1, d.y1, d.x2, d.y2, f.frame_w, f.frame_h from ({fx.DET}) d join ({fx.FRAMES}) f on d.frame_id = f.frame_id", """
, p as (select *, greatest(64, cast(trunc(greatest(x2 - x1, y2 - y1) * 2 / 2) as int)) as pad from src)
select det_id, cast(trunc(greatest(0, x1 - pad)) as int) as x1, cast(trunc(greatest(0, y1 - pad)) as int) as y1,
  cast(trunc(least(frame_w, x2 + pad)) as int) as x2, cast(trunc(least(frame_h, y2 + pad)) as int) as y2 from p""")
def _(df):
    return df.select("det_id", geo.expand_crop(geo.box(), F.col("frame_w"), F.col("frame_h"), 3).alias("b")).select("det_id", "b.*")


@over("center_boxes", f"select p.*, f.frame_w, f.frame_h from ({fx.PREDICTIONS}) p join ({fx.FRAMES}) f on p.frame_id = f.frame_id", """
select frame_id, det_ord, least(greatest(cast(trunc((cx - w / 2) * (frame_w / cast(640 as double))) as int), 0), frame_w) as x1,
  least(greatest(cast(trunc((cy - h / 2) * (frame_h / cast(640 as double))) as int), 0), frame_h) as y1,
  least(greatest(cast(trunc((cx + w / 2) * (frame_w / cast(640 as double))) as int), 0), frame_w) as x2,
  least(greatest(cast(trunc((cy + h / 2) * (frame_h / cast(640 as double))) as int), 0), frame_h) as y2 from src""")
def _(df):
    b = geo.from_center(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.col("frame_w") / 640.0, F.col("frame_h") / 640.0, F.col("frame_w"), F.col("frame_h"))
    return df.select("frame_id", "det_ord", b.alias("b")).select("frame_id", "det_ord", "b.*")


@over("tile_offset", f"select det_id, x1, y1, x2, y2, cast((det_id%5)*320 as int) as tx, cast((det_id%3)*320 as int) as ty, cast(case det_id%3 when 0 then 0.75 when 1 then 1 else 1.25 end as double) as scale from ({fx.DET}) d", """
select det_id, round((x1 + tx) / scale, 6) + 0.0 as x1, round((y1 + ty) / scale, 6) + 0.0 as y1, round((x2 + tx) / scale, 6) + 0.0 as x2, round((y2 + ty) / scale, 6) + 0.0 as y2 from src""")
def _(df):
    b = df.select("det_id", geo.untile(geo.box(), F.col("tx"), F.col("ty"), F.col("scale")).alias("b"))
    return b.select("det_id", *(r6(f"b.{c}", c) for c in nms.BOX))


_STARTS = "range(0, cast({0} as bigint) - 639, 320)"


@over("tile_grid", fx.FRAMES, f"""
, s as (select frame_id, unnest([cast(0.75 as double), 1.0, 1.25]) as scale, frame_w, frame_h from src),
z as (select frame_id, scale, cast(trunc(frame_w * scale) as int) as w, cast(trunc(frame_h * scale) as int) as h from s),
g as (select frame_id, scale, unnest(list_concat(
  flatten(list_transform({_STARTS.format('h')}, lambda y: list_transform({_STARTS.format('w')}, lambda x: {{'x': x, 'y': y}}))),
  case when w % 640 <> 0 then list_transform({_STARTS.format('h')}, lambda y: {{'x': cast(greatest(0, w - 640) as bigint), 'y': y}}) else [] end,
  case when h % 640 <> 0 then list_transform({_STARTS.format('w')}, lambda x: {{'x': x, 'y': cast(greatest(0, h - 640) as bigint)}}) else [] end,
  case when w % 640 <> 0 and h % 640 <> 0 then [{{'x': cast(greatest(0, w - 640) as bigint), 'y': cast(greatest(0, h - 640) as bigint)}}] else [] end)) as t from z)
select frame_id, scale, cast(t.x as int) as x, cast(t.y as int) as y, count(*) as n from g group by all""")
def _(df):
    return tiles.tile_grid(df, ["frame_id"]).groupBy("frame_id", "scale", "x", "y").agg(F.count("*").alias("n"))


@over("eval_tile_grid", fx.FRAMES, """
, g as (select frame_id, frame_w, frame_h, unnest(range(0, frame_w, 320)) as x from src), h as (select *, unnest(range(0, frame_h, 320)) as y from g)
select frame_id, cast(x as int) as x, cast(y as int) as y, cast(least(x + 640, frame_w) as int) as x2, cast(least(y + 640, frame_h) as int) as y2 from h""")
def _(df):
    return tiles.eval_grid(df, ["frame_id"])


_COLORS = "select event_id, cast((event_id*37)%256 as double) as b, cast((event_id*91)%256 as double) as g, cast((event_id*53)%256 as double) as r from events"


@over("color_class", _COLORS, """
select event_id, case when r > 150 and g < 100 and b < 100 then 'red' when r > 200 and g > 150 and b < 80 then 'yellow' when r > 150 and g > 100 and b < 50 then 'orange' else 'white' end as color from src""")
def _(df):
    return df.select("event_id", geo.color_class(F.col("b"), F.col("g"), F.col("r")).alias("color"))


@over("temporal_boost", f"select det_id, conf, cast(det_id%25 as int) as age from ({fx.DET}) d", """
select det_id, round(least(conf * (1 + least(age * cast(0.03 as double), cast(1.3 as double) - 1)), 1), 6) + 0.0 as conf from src""")
def _(df):
    return df.select("det_id", r6(geo.boosted(F.col("conf"), F.col("age")), "conf"))


# ---- filters


@over("frame_sampling", fx.FRAMES, "select frame_id from src where frame_id % 3 = 0")
def _(df):
    return frames.sampled(df).select("frame_id")


@over("duration_limit", fx.FRAMES, "select frame_id from src where frame_id <= 75")
def _(df):
    return frames.limited(df, 2.5, 30).select("frame_id")


@over("candidate_size", fx.DET, "select det_id from src where x2 - x1 >= 70 and y2 - y1 >= 55 and (x2 - x1) * (y2 - y1) <= 6500 and (x2 - x1) / (y2 - y1) > 1 and (x2 - x1) / (y2 - y1) < cast(1.5 as double)")
def _(df):
    return candidates.sized(df, 70, 55, 6500, 1.0, 1.5).select("det_id")


_BEST = "greatest(s0, s1, s2)"


@over("decode_predictions", fx.PREDICTIONS, f"""
select frame_id, det_ord, round(obj * {_BEST}, 6) + 0.0 as conf, case when s0 = {_BEST} then 0 when s1 = {_BEST} then 1 else 2 end as class_id
from src where obj >= cast(0.3 as double) and obj * {_BEST} >= cast(0.3 as double)""")
def _(df):
    return nms.decode_predictions(df.withColumn("scores", F.array("s0", "s1", "s2")), 0.3, ["frame_id"]).select("frame_id", "det_ord", r6("conf", "conf"), "class_id")


@over("ocr_confidence", fx.VARIANTS, "select crop_id, line_no from src where conf >= cast(0.5 as double)")
def _(df):
    return frames.reliable_lines(df).select("crop_id", "line_no")


@over("first_variant", fx.VARIANTS, """
, g as (select * from src where conf >= cast(0.5 as double)), m as (select crop_id, min(variant) as variant from g group by 1)
select g.crop_id, g.variant, g.line_no from g join m on g.crop_id = m.crop_id and g.variant = m.variant""")
def _(df):
    return frames.first_variant(df, ["crop_id"]).select("crop_id", "variant", "line_no")


# ---- suppression, fusion, matching


def nms_parts(rows: str, threshold: float, order: str = "conf desc, det_ord", name: str = "") -> str:
    """CTEs of a greedy suppression over ``rows``; ``kept{name}`` has what stays, with its rank ``rk``."""
    n = name
    return f"""
r{n} as (select *, row_number() over (partition by frame_id order by {order}) as rk from {rows}),
f{n} as (
  select frame_id, cast(0 as bigint) as rk, cast([] as struct(x1 double, y1 double, x2 double, y2 double, rk bigint)[]) as kept from (select distinct frame_id from r{n})
  union all
  select f.frame_id, r.rk, case when len(list_filter(f.kept, lambda q: {iou_sql('q.', 'r.')} >= cast({threshold} as double))) > 0 then f.kept
    else list_append(f.kept, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'rk': r.rk}}) end
  from f{n} f join r{n} r on r.frame_id = f.frame_id and r.rk = f.rk + 1
),
kept{n} as (
  select r.* from r{n} r join (select frame_id, max_by(kept, rk) as kept from f{n} group by 1) l on l.frame_id = r.frame_id
  where list_contains(list_transform(l.kept, lambda q: q.rk), r.rk)
)"""


def _nms(name: str, statement: str, threshold: float, columns: str) -> None:
    sql = f"with recursive src as ({statement}), {nms_parts('src', threshold)} select {columns} from kept"
    over(name, statement, sql)(lambda df: nms.suppress(df, ["frame_id"], threshold).select(*columns.split(", ")))


_nms("nms_color", fx.DET, 0.2, "frame_id, det_id")
_nms("nms_sources", f"select * from ({fx.DET}) d where source = 'color'", 0.45, "frame_id, det_id")
_nms("nms_npu", fx.DET, 0.45, "frame_id, det_id")


def _fusion_sql(statement: str, skip: float, single: bool, corner: str) -> str:
    keep = f"avg(conf) >= cast({skip} as double)" + (" or max(n) = 1" if single else "")
    mean = lambda c: corner.format(f"sum({c} * conf) / sum(conf)")
    return f"""with recursive src as ({statement}), {nms_parts('src', 0.45, 'conf desc, det_ord desc')},
m as (select b.frame_id, b.rk, min(s.rk) as seed from r b join kept s on s.frame_id = b.frame_id and (s.rk = b.rk or {iou_sql('s.', 'b.')} >= cast(0.45 as double)) group by 1, 2),
b as (select r.*, m.seed, count(*) over (partition by r.frame_id) as n from r join m on m.frame_id = r.frame_id and m.rk = r.rk)
select frame_id, count(*) as members, {mean('x1')} as x1, {mean('y1')} as y1, {mean('x2')} as x2, {mean('y2')} as y2, round(avg(conf), 6) + 0.0 as conf
from b group by frame_id, seed having {keep}"""


# corners are exact halves of the last place for some clusters, so they are moved off before rounding
@over("box_fusion", fx.DET, _fusion_sql(fx.DET, 0.0, False, "round({} + cast(1e-7 as double), 4) + 0.0"))
def _(df):
    return nms.fuse(df, ["frame_id"], 0.45).select("frame_id", "members", *((F.round(F.col(c) + 1e-7, 4) + F.lit(0.0)).alias(c) for c in nms.BOX), r6("conf", "conf"))


_TILED = f"select * from ({fx.DET}) d where frame_id%7 <> 0 or det_ord = 3"


@over("tile_fusion", _TILED, _fusion_sql(_TILED, 0.505, True, "cast(trunc(round({}, 9)) as int)"))
def _(df):
    fused = nms.fuse(df, ["frame_id"], 0.45, 0.505, single_passes=True)
    return fused.select("frame_id", "members", *(F.round(c, 9).cast("int").alias(c) for c in nms.BOX), r6("conf", "conf"))


_FREE = f"""free as (select * from src c where source <> 'yolo' and not exists (select 1 from src y where y.frame_id = c.frame_id and y.source = 'yolo' and {iou_sql('c.', 'y.')} >= cast(0.45 as double)))"""


@over("source_merge", fx.DET, f"""with recursive src as ({fx.DET}), {_FREE}, {nms_parts('free', 0.45)},
u as (select frame_id, det_id, 0 as g, det_ord as o, cast(0 as double) as c from src where source = 'yolo' union all select frame_id, det_id, 1, det_ord, -conf from kept)
select frame_id, det_id, cast(row_number() over (partition by frame_id order by g, c, o) - 1 as int) as rank from u""")
def _(df):
    return nms.merge_sources(df, ["frame_id"]).select("frame_id", "det_id", "rank")


_FOUND = f"select det_id, frame_id, det_ord, x1 + (det_id*37)%40 as x1, y1, x2 + (det_id*37)%40 as x2, y2 from ({fx.DET}) d"
_MATCH = f"""with recursive t as ({fx.DET}), b as ({_FOUND}),
f as (
  select frame_id, cast(-1 as int) as o, cast([] as int[]) as used from (select distinct frame_id from b)
  union all
  select f.frame_id, f.o + 1, case when b.det_id is null then f.used else coalesce((
    select list_append(f.used, min(t.det_ord)) from t where t.frame_id = f.frame_id and not list_contains(f.used, t.det_ord) and {iou_sql('b.', 't.')} >= cast(0.45 as double)
    having count(*) > 0), f.used) end
  from f left join b on b.frame_id = f.frame_id and b.det_ord = f.o + 1 where f.o < 19
), l as (select frame_id, max_by(used, o) as used from f group by 1),
n as (select b.frame_id, count(*) as n_found from b group by 1), m as (select frame_id, count(*) as n_truth from t group by 1)
"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nms.first_matches(fx.view(spark, sf_dir, _FOUND), fx.view(spark, sf_dir, fx.DET), ["frame_id"])


@query("first_match", _MATCH + "select frame_id, cast(len(used) as int) as tp, cast(n_found as int) as n_found, cast(n_truth as int) as n_truth from l join n using (frame_id) join m using (frame_id)")
def _(spark, sf_dir):
    return _matches(spark, sf_dir).select("frame_id", "tp", "n_found", "n_truth")


@query("agreement", _MATCH + """, z as (select cast(sum(len(used)) as bigint) as tp, cast(sum(n_found) as bigint) as d, cast(sum(n_truth) as bigint) as r from l join n using (frame_id) join m using (frame_id))
select tp, d - tp as fp, r - tp as fn, d as total_detections, r as total_reference, round(tp / d, 6) + 0.0 as precision, round(tp / r, 6) + 0.0 as recall,
  round(2 * (tp / d) * (tp / r) / (tp / d + tp / r), 6) + 0.0 as f1 from z""")
def _(spark, sf_dir):
    got = nms.agreement(_matches(spark, sf_dir))
    return got.select("tp", "fp", "fn", "total_detections", "total_reference", *(r6(c, c) for c in ("precision", "recall", "f1")))


@over("top_of_class", f"select frame_id, det_ord, det_id, conf, cast(det_id%2 as int) as class_id from ({fx.DET}) d", """
, r as (select *, row_number() over (partition by frame_id order by conf desc, det_ord) as k from src where class_id = 0) select frame_id, det_id from r where k = 1""")
def _(df):
    return nms.top_of_class(df, ["frame_id"]).select("frame_id", "det_id")


@over("top_list", fx.DET, "select det_id, conf from src order by conf desc, det_id limit 10")
def _(df):
    return nms.top_list(df).select("det_id", "conf")


@over("size_profile", f"select source, conf, x1, y1, x1 + (x2 - x1) * (1 + det_id%4) as x2, y1, y1 + (y2 - y1) * (1 + det_id%3) as y2 from ({fx.DET}) d", """
select source, count(*) filter ((x2 - x1) * (y2 - y1) < 10000) as small, count(*) filter ((x2 - x1) * (y2 - y1) >= 10000 and (x2 - x1) * (y2 - y1) < 40000) as medium,
  count(*) filter ((x2 - x1) * (y2 - y1) >= 40000) as large, round(avg(conf), 6) + 0.0 as mean_conf from src group by 1""")
def _(df):
    return nms.size_profile(df, ["source"]).withColumn("mean_conf", r6("mean_conf"))


# ---- candidates from coloured boxes

_NEAR = """
red as (select * from src where color = 'red'), white as (select * from src where color = 'white'),
d as (select r.frame_id, r.det_ord as r_ord, w.det_ord as w_ord, sqrt(power((r.x1 + r.x2) / 2 - (w.x1 + w.x2) / 2, 2) + power((r.y1 + r.y2) / 2 - (w.y1 + w.y2) / 2, 2)) as d
  from red r join white w on r.frame_id = w.frame_id),
n as (select frame_id, r_ord, w_ord from (select *, row_number() over (partition by frame_id, r_ord order by d, w_ord) as k from d where d < 60) where k = 1)
"""


@over("nearest_white", fx.COLORED, f", {_NEAR} select r.frame_id, r.det_ord as red, n.w_ord as white from red r left join n on n.frame_id = r.frame_id and n.r_ord = r.det_ord")
def _(df):
    return candidates.nearest_white(df, ["frame_id"], 60).select("frame_id", F.col("r_det_ord").alias("red"), F.col("w_det_ord").alias("white"))


_MADE = f"""{_NEAR},
j as (select r.frame_id, r.det_ord as o, least(r.x1, w.x1) as x1, least(r.y1, w.y1) as y1, greatest(r.x2, w.x2) as x2, greatest(r.y2, w.y2) as y2
  from n join red r on r.frame_id = n.frame_id and r.det_ord = n.r_ord join white w on w.frame_id = n.frame_id and w.det_ord = n.w_ord),
taken as (select distinct w.frame_id, w.x1, w.y1, w.x2, w.y2 from n join white w on w.frame_id = n.frame_id and w.det_ord = n.w_ord),
made as (
  select frame_id, x1, y1, x2, y2, least(cast(0.6 as double) + cast(0.3 as double) * least((x2 - x1) / 300, 1), cast(0.95 as double)) as conf, 'promo' as tag_type, 0 as g, o from j where (x2 - x1) * (y2 - y1) < 80000
  union all select r.frame_id, x1, y1, x2, y2, 0.5, 'promo', 1, det_ord from red r where not exists (select 1 from n where n.frame_id = r.frame_id and n.r_ord = r.det_ord) and y2 - y1 > 30 and (x2 - x1) * (y2 - y1) < 30000
  union all select frame_id, x1, y1, x2, y2, least(cast(0.5 as double) + cast(0.3 as double) * least((x2 - x1) / 250, 1), cast(0.85 as double)), 'pricetag', 2, det_ord from white w
    where not exists (select 1 from taken t where t.frame_id = w.frame_id and t.x1 = w.x1 and t.y1 = w.y1 and t.x2 = w.x2 and t.y2 = w.y2)
  union all select frame_id, x1, y1, x2, y2, 0.55, 'promo', 3, det_ord from src where color = 'yellow'),
numbered as (select frame_id, x1, y1, x2, y2, cast(conf as double) as conf, tag_type, row_number() over (partition by frame_id order by g, o) - 1 as det_ord from made)"""
_CAND = "frame_id, cast(det_ord as int) as det_ord, tag_type, round(conf, 6) + 0.0 as conf, x1, y1, x2, y2"


@over("color_candidates", fx.COLORED, f", {_MADE} select {_CAND} from numbered")
def _(df):
    return candidates.candidates(df, ["frame_id"], 60).select("frame_id", "det_ord", "tag_type", r6("conf", "conf"), *nms.BOX)


@over("detect_candidates", fx.COLORED, f"with recursive src as ({fx.COLORED}), {_MADE}, {nms_parts('numbered', 0.2)} select {_CAND} from kept")
def _(df):
    return candidates.detect(df, ["frame_id"], 60).select("frame_id", "det_ord", "tag_type", r6("conf", "conf"), *nms.BOX)


# ---- text of a tag

_TEXTS = f"select crop_id, line_no, text from ({fx.OCR_LINES}) o"
_VALUE = r"cast(replace(nullif(regexp_extract({0}, '([0-9]{{1,5}})[.,]([0-9]{{1,2}})|([0-9]{{1,5}})'), ''), ',', '.') as double)"
_STRIPPED = "regexp_replace(text, '[^0-9.,]', '', 'g')"
_DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
_PRICES = {
    "export": (_VALUE.format(_STRIPPED), f"length({_DIGITS}) < 12 and length({_STRIPPED}) < 12", 1000000),
    "ocr": (
        _VALUE.format("trim(text)"),
        rf"not regexp_full_match(trim(text), '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}') and not regexp_full_match(trim(text), '[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?') and not (length({_DIGITS}) >= 6 and not regexp_matches(text, '[.,]'))",
        999999,
    ),
    "paddle": (_VALUE.format(_STRIPPED), "true", 1000000),
}


def _texts(df: DataFrame) -> DataFrame:
    return df.groupBy("crop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"))  # a tag's few lines


def _price_cte(engine: str) -> str:
    value, test, high = _PRICES[engine]
    return f"""p as (select crop_id, list_reverse_sort(list(distinct v)) as p from (select crop_id, {value} as v from src where {test}) where v between 10 and {high} group by 1),
c as (select distinct crop_id from src), q as (select c.crop_id, p.p from c left join p using (crop_id))"""


for _engine in _PRICES:
    over(f"prices_{_engine}", _TEXTS, f", {_price_cte(_engine)} select crop_id, coalesce(array_to_string(list_transform(p, lambda x: printf('%.2f', x)), ' '), '') as prices from q")(
        lambda df, e=_engine: _texts(df).select("crop_id", F.coalesce(F.array_join(F.transform(text.price_list(F.col("texts"), e), lambda p: F.format_string("%.2f", p)), " "), F.lit("")).alias("prices"))
    )


@over("price_assignment", _TEXTS, f", {_price_cte('ocr')} select crop_id, p[1] as price_default, p[2] as price_card, p[3] as price_discount from q")
def _(df):
    return _texts(df).select("crop_id", *(p.alias(n) for p, n in zip(text.ranked_prices(text.price_list(F.col("texts"), "ocr")), ("price_default", "price_card", "price_discount"))))


def _first(name: str, pick: Callable[[Column], Column], expression: str) -> None:
    sql = f", x as (select crop_id, min_by(v, line_no) as v from (select crop_id, line_no, nullif({expression}, '') as v from src) where v is not null group by 1) select c.crop_id, x.v from (select distinct crop_id from src) c left join x using (crop_id)"
    over(name, _TEXTS, sql)(lambda df: _texts(df).select("crop_id", pick(F.col("texts")).alias("v")))


_CODE = "regexp_extract(' ' || text || ' ', '[^0-9A-Za-z_]([0-9]{12,13})[^0-9A-Za-z_]', 1)"


def _ean_sql(code: str) -> str:
    total = f"list_sum(list_transform(range(1, length({code})), lambda i: cast(substr({code}, i, 1) as int) * case when i % 2 = 0 then 3 else 1 end))"
    return f"(length({code}) in (12, 13) and (10 - cast({total} as int) % 10) % 10 = cast(right({code}, 1) as int))"


_first("discount_text", text.discount, r"regexp_extract(text, '-?[0-9]+\s*%')")
_first("date_text", text.date_text, "regexp_extract(text, '[0-9]{2}[./][0-9]{2}[./][0-9]{2,4}')")
_first("barcode_text", text.barcode, f"case when {_CODE} = '' then '' when {_ean_sql(_CODE)} then {_CODE} else '' end")
_first("export_name", text.first_name, "case when length(text) > 15 and not regexp_matches(text, '[0-9]{6,}') and not regexp_matches(text, '^[0-9]+[.,]?[0-9]*$') then text else '' end")


@over("text_kinds", _TEXTS, rf"""
select crop_id, line_no, length({_DIGITS}) >= 12 as barcode_like, regexp_full_match(trim(text), '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}') as date_like,
  regexp_full_match(trim(text), '[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?') as time_like, length({_DIGITS}) >= 6 and not regexp_matches(text, '[.,]') as sku_like from src""")
def _(df):
    t = F.col("text")
    return df.select("crop_id", "line_no", text.is_barcode_like(t).alias("barcode_like"), text.is_date_like(t).alias("date_like"), text.is_time_like(t).alias("time_like"), text.is_sku_like(t).alias("sku_like"))


@over("ean_check", f"select crop_id, substr(text, 6, 13) as code from ({fx.OCR_LINES}) o where line_no = 4", f"select crop_id, {_ean_sql('code')} as valid from src")
def _(df):
    return df.select("crop_id", text.valid_ean(F.col("code")).alias("valid"))


_EVERY = "e as (select crop_id, string_agg(text, ' ' order by line_no) as t from src group by 1)"


@over("ocr_symbols", _TEXTS, f""", {_EVERY} select crop_id, nullif(array_to_string(list_filter([case when contains(t, '%') then '%' end, case when regexp_matches(t, '[Шш]') then 'Ш' end,
  case when regexp_matches(t, '[★☆]') then '★' end, case when regexp_matches(t, '[№#]') then '№' end], lambda x: x is not null), ','), '') as symbols from e""")
def _(df):
    return _texts(df).select("crop_id", text.ocr_symbols(F.col("texts")).alias("symbols"))


@over("export_symbols", _TEXTS, f""", {_EVERY} select crop_id, nullif(array_to_string(list_filter([case when contains(t, '%') then '%' end, case crop_id%3 when 0 then 'red' when 1 then 'yellow' end],
  lambda x: x is not null), ','), '') as symbols from e""")
def _(df):
    color = F.when(F.col("crop_id") % 3 == 0, "red").when(F.col("crop_id") % 3 == 1, "yellow").otherwise("white")
    return _texts(df).select("crop_id", text.export_symbols(F.col("texts"), color).alias("symbols"))


_PLAIN = "not regexp_full_match(text, '[0-9.,%/\\-]+')"
_NAME = f"nm as (select crop_id, max_by(text, length(text) * 1000 - line_no) as name from src where length(text) > 10 and not regexp_matches(text, '[0-9]{{6,}}') and {_PLAIN} group by 1)"


@over("ocr_name", _TEXTS, f", {_NAME} select c.crop_id, name from (select distinct crop_id from src) c left join nm using (crop_id)")
def _(df):
    return _texts(df).select("crop_id", text.longest_name(F.col("texts")).alias("name"))


@over("plain_name", f"select crop_id, line_no, case when crop_id%4 = 0 then regexp_replace(text, '[0-9].*$', '') else text end as text from ({fx.OCR_LINES}) o", """
, x as (select crop_id, string_agg(text, ' ' order by line_no) as name from src where not regexp_matches(text, '[0-9]') group by 1)
select c.crop_id, nullif(name, '') as name from (select distinct crop_id from src) c left join x using (crop_id)""")
def _(df):
    return _texts(df).select("crop_id", text.plain_name(F.col("texts")).alias("name"))


_INFO = rf""", {_EVERY}, {_NAME}, {{prices}},
k as (select crop_id, t, nullif(regexp_extract(' ' || t || ' ', '[^0-9A-Za-z_]([0-9]{{{{12,13}}}})[^0-9A-Za-z_]', 1), '') as raw_code from e),
b as (select crop_id, t, case when {{check}} then raw_code end as barcode from k),
a as (select crop_id, string_agg(text, ' | ' order by line_no) as additional_info from (
  select s.*, row_number() over (partition by s.crop_id order by line_no) as n from src s left join nm using (crop_id) where length(text) between 4 and 29 and text is distinct from name and {_PLAIN}) where n <= 3 group by 1)
select b.crop_id, p[1] as price_default, p[2] as price_card, p[3] as price_discount, nullif(regexp_extract(t, '-?[0-9]+\s*%'), '') as discount_amount, barcode,
  nullif(regexp_extract(t, '[0-9]{{{{2}}}}[./][0-9]{{{{2}}}}[./][0-9]{{{{2,4}}}}'), '') as print_datetime, name as product_name,
  case when barcode is null then nullif(regexp_extract(' ' || t || ' ', '[^0-9A-Za-z_]([0-9]{{{{9,15}}}})[^0-9A-Za-z_]', 1), '') end as id_sku,
  nullif(concat_ws(',', case when contains(t, '%') then '%' end, case when regexp_matches(t, '[№#]') then '№' end), '') as special_symbols, additional_info
from b join q using (crop_id) left join nm using (crop_id) left join a using (crop_id)"""
for _engine, _check in (("ocr", f"raw_code is not null and {_ean_sql('raw_code')}"), ("paddle", "true")):
    over(f"tag_info_{_engine}", _TEXTS, _INFO.replace("{prices}", _price_cte(_engine)).replace("{check}", _check).replace("{{", "{").replace("}}", "}"))(
        lambda df, e=_engine: _texts(df).select("crop_id", text.tag_info(F.col("texts"), e).alias("i")).select("crop_id", "i.*")
    )


@over("simple_info", _TEXTS, f""", {_price_cte('ocr')}, {_NAME},
k as (select crop_id, min_by({_CODE}, line_no) as code from src where {_CODE} <> '' and {_ean_sql(_CODE)} group by 1)
select q.crop_id, p[1] as price_default, p[2] as price_card, p[3] as price_discount, code as barcode, name as product_name from q left join nm using (crop_id) left join k using (crop_id)""")
def _(df):
    return _texts(df).select("crop_id", text.simple_info(F.col("texts")).alias("i")).select("crop_id", "i.*")


@over("single_fields", _TEXTS, f""", {_price_cte('ocr')},
k as (select crop_id, min_by({_CODE}, line_no) as code from src where {_CODE} <> '' and {_ean_sql(_CODE)} group by 1),
x as (select crop_id, string_agg(text, ' ' order by line_no) as name from src where not regexp_matches(text, '[0-9]') group by 1)
select q.crop_id, p[1] as price, name as product_name, case when q.crop_id%2 = 0 then '4600644110002' else code end as barcode,
  case when q.crop_id%3 > 0 then 'qr ' || cast(q.crop_id as string) end as qr_code from q left join x using (crop_id) left join k using (crop_id)""")
def _(df):
    decoded = F.when(F.col("crop_id") % 2 == 0, "460-0644110002").otherwise("4600644110006")
    payload = F.when(F.col("crop_id") % 3 > 0, F.concat(F.lit("qr "), F.col("crop_id").cast("string"))).otherwise("")
    return _texts(df).select("crop_id", text.single_fields(F.col("texts"), decoded, payload).alias("i")).select("crop_id", "i.*")


# ---- QR payloads


@over("qr_parse", fx.QR, """
select crop_id, case when starts_with(raw, '{') then 'price=' || json_extract_string(raw, '$.price') || ';sku=' || json_extract_string(raw, '$.sku') when contains(raw, '=') then raw
  when contains(raw, '|') then array_to_string(list_transform(range(0, len(string_split(raw, '|'))), lambda i: 'field_' || i || '=' || string_split(raw, '|')[i + 1]), ';') else 'raw=' || raw end as fields from src""")
def _(df):
    entries = F.array_sort(F.transform(F.map_entries(qr.parse(F.col("raw"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return df.select("crop_id", F.array_join(entries, ";").alias("fields"))


@over("qr_row", fx.QR, """
select crop_id, case when crop_id%4 = 3 then raw end as raw_qr_data, case when crop_id%4 = 2 then null else regexp_extract(raw, '[0-9]+[.,][0-9]+') end as price1_qr,
  cast(null as varchar) as price2_qr, case crop_id%4 when 0 then json_extract_string(raw, '$.sku') when 1 then regexp_extract(raw, 'sku=([0-9]+)', 1) end as id_sku from src""")
def _(df):
    row = qr.to_row(qr.parse(F.col("raw")), F.lit(""), F.lit(""))
    return df.select("crop_id", row.alias("r")).select("crop_id", "r.raw_qr_data", "r.price1_qr", "r.price2_qr", "r.id_sku")


# ---- catalog

_PROBES = f"select crop_id as probe_id, case crop_id%3 when 0 then cast(crop_id%700 as string) when 1 then lpad(cast(crop_id%700 as string), 9, '0') else '4600' || lpad(cast(crop_id as string), 9, '0') end as code from ({fx.QR}) q"
_LOOKUP = f"""with cat as (select code, max_by(fullname, row_no) as n from (select row_no, trim(fullname) as fullname, trim(code) as code from ({fx.CATALOG}) c) where code <> '' and fullname <> '' group by 1),
p as ({_PROBES}), f as (select p.*, coalesce(a.n, b.n, c.n) as fullname from p left join cat a on a.code = p.code left join cat b on b.code = ltrim(p.code, '0')
  left join cat c on c.code = case when length(p.code) >= 13 then p.code else lpad(p.code, 13, '0') end)
"""


@query("catalog_lookup", _LOOKUP + "select probe_id, code, fullname from f")
def _(spark, sf_dir):
    return products.lookup(fx.view(spark, sf_dir, _PROBES), fx.view(spark, sf_dir, fx.CATALOG))


@query("lookup_gating", _LOOKUP + "select probe_id, case when probe_id%5 = 0 then 'known' when probe_id%5 = 4 then '' else coalesce(fullname, '') end as product_name from f")
def _(spark, sf_dir):
    rows = fx.view(spark, sf_dir, _PROBES).select("probe_id", F.when(F.col("probe_id") % 5 == 0, "known").otherwise("").alias("product_name"), F.when(F.col("probe_id") % 5 == 1, F.col("code")).otherwise("").alias("barcode"), F.when(F.col("probe_id") % 5 != 4, F.col("code")).alias("ocr"))
    return products.fill_names(rows, fx.view(spark, sf_dir, fx.CATALOG), "ocr").select("probe_id", "product_name")


@over("catalog_entries", fx.CATALOG, "select code, max_by(fullname, row_no) as fullname from src group by 1")
def _(df):
    return products.entries(df)


# ---- export rows


@over("text_row", _TEXTS, f""", {_price_cte('export')}, {_EVERY},
n as (select crop_id, min_by(text, line_no) as name from src where length(text) > 15 and not regexp_matches(text, '[0-9]{{6,}}') and not regexp_matches(text, '^[0-9]+[.,]?[0-9]*$') group by 1),
k as (select crop_id, min_by({_CODE}, line_no) as code from src where {_CODE} <> '' and {_ean_sql(_CODE)} group by 1)
select q.crop_id, coalesce(printf('%.2f', p[1]), '') as price_default, coalesce(printf('%.2f', p[2]), '') as price_card, coalesce(printf('%.2f', p[3]), '') as price_discount,
  regexp_extract(t, '-?[0-9]+\\s*%') as discount_amount, coalesce(code, '') as barcode, regexp_extract(t, '[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{2,4}}') as print_datetime,
  coalesce(name, '') as product_name, case when contains(t, '%') then '%' else '' end as special_symbols, 'white' as color
from q join e using (crop_id) left join n using (crop_id) left join k using (crop_id)""")
def _(df):
    rows = _texts(df)
    mean = F.struct(F.lit(200.0).alias("b"), F.lit(200.0).alias("g"), F.lit(210.0).alias("r"))
    blank = export.blank_rows(rows, ["crop_id", "texts"])
    out = export.updated(blank, export.text_fields(F.col("texts"), mean, F.col("product_name")))
    return out.select("crop_id", "price_default", "price_card", "price_discount", "discount_amount", "barcode", "print_datetime", "product_name", "special_symbols", "color")


@over("box_row", fx.DET, "select det_id, 'cam' as filename, cast(frame_id as varchar) as frame_timestamp, cast(cast(trunc(x1) as int) as varchar) as x_min, cast(cast(trunc(y1) as int) as varchar) as y_min, cast(cast(trunc(x2) as int) as varchar) as x_max, cast(cast(trunc(y2) as int) as varchar) as y_max, 25 as blank from src")
def _(df):
    rows = export.blank_rows(df, ["det_id"], **export.box_fields(geo.box(), F.lit("cam"), F.col("frame_id")))
    blank = sum(F.when(F.col(c) == "", 1).otherwise(0) for c in EXPORT_COLUMNS)
    return rows.select("det_id", "filename", "frame_timestamp", "x_min", "y_min", "x_max", "y_max", blank.alias("blank"))


@over("fill_blank", fx.TRACK_ROWS, "select arrival, case when product_name = '' and arrival%2 = 0 then 'ocr' else product_name end as product_name from src")
def _(df):
    rows = export.blank_rows(df, ["arrival"], product_name=F.col("product_name"))
    return export.updated(rows, {"product_name": F.when(F.col("arrival") % 2 == 0, "ocr").otherwise(""), "unknown": F.lit("x")}, only_blank=True).select("arrival", "product_name")


@over("qr_export", fx.QR, """
select crop_id, case when crop_id%4 = 3 then raw else '' end as raw_qr_data, case when crop_id%4 = 2 then '' else regexp_extract(raw, '[0-9]+[.,][0-9]+') end as price1_qr,
  case when crop_id%5 = 0 then '123456789' when crop_id%4 = 0 then json_extract_string(raw, '$.sku') when crop_id%4 = 1 then regexp_extract(raw, 'sku=([0-9]+)', 1) else '' end as id_sku from src""")
def _(df):
    rows = export.blank_rows(df, ["crop_id", "raw"], id_sku=F.when(F.col("crop_id") % 5 == 0, "123456789").otherwise(""))
    return export.with_qr(rows, qr.parse(F.col("raw"))).select("crop_id", "raw_qr_data", "price1_qr", "id_sku")


@over("row_validation", fx.CHECK_ROWS, """
, b as (select *, regexp_replace(barcode, '[^0-9]', '', 'g') as d, x_min <> '' and not coalesce(try_cast(x_min as double) >= 0 and try_cast(x_max as double) > try_cast(x_min as double) and try_cast(y_max as double) > try_cast(y_min as double) and try_cast(y_min as double) >= 0, false) as bad from src)
select arrival, case when try_cast(price_default as double) > 0 and try_cast(price_default as double) <= 9999999 then price_default else '' end as price_default,
  case when length(d) between 8 and 14 then d else '' end as barcode, case when bad then '' else x_min end as x_min, case when bad then '' else y_min end as y_min,
  case when bad then '' else x_max end as x_max, case when bad then '' else y_max end as y_max from b""")
def _(df):
    return export.validated(df)


@query("new_tag_rows")
def _(spark, sf_dir):
    """Boxes, texts, QR payloads and catalog put together; each part has SQL of its own, and a test holds whole rows."""
    tags = _texts(fx.view(spark, sf_dir, _TEXTS)).join(fx.view(spark, sf_dir, fx.QR), "crop_id")
    made = tags.select(F.col("crop_id").alias("tracker_id"), F.lit("cam").alias("filename"), F.col("crop_id").alias("frame_id"), *(F.lit(v).cast("double").alias(c) for v, c in zip((10, 20, 110, 90), nms.BOX)),
                       "texts", F.struct(*(F.lit(v).alias(c) for v, c in zip((30.0, 150.0, 220.0), "bgr"))).alias("mean_color"), F.col("raw").alias("qr"))
    return export.new_tag_rows(made, fx.view(spark, sf_dir, fx.CATALOG))


@over("best_rows", fx.TRACK_ROWS, """
, f as (select *, (price_default <> '')::int + (barcode <> '')::int + (product_name <> '')::int as n from src),
g as (select *, row_number() over (partition by tracker_id order by n desc, arrival) as k, min(arrival) over (partition by tracker_id) as m from f)
select tracker_id, arrival, case when tracker_id = '' then arrival else m end as first_seen, price_default, barcode, product_name from g where k = 1 or tracker_id = ''""")
def _(df):
    rows = export.blank_rows(df, ["arrival"], **{c: F.col(c) for c in ("tracker_id", "filename", "price_default", "barcode", "product_name")})
    return export.best_rows(rows, "arrival").select("tracker_id", "arrival", "first_seen", "price_default", "barcode", "product_name")


@over("text_merge", fx.TRACK_TEXTS, """
, a as (select *, row_number() over (partition by track_id, key order by ord) = 1 as f from src)
select track_id, key, value from (select *, row_number() over (partition by track_id, key order by length(value) desc, ord) as k from a where f or value <> '') where k = 1""")
def _(df):
    return export.merged_texts(df, ["track_id"])


@over("running_confidence", fx.TDET, "select video_id, frame_id, det_ord, max(conf) over (partition by video_id, det_ord order by frame_id rows unbounded preceding) as max_conf from src")
def _(df):
    return export.running_confidence(df, ["video_id", "det_ord"], "frame_id").select("video_id", "frame_id", "det_ord", "max_conf")


# ---- frames: calibration and density


@over("hsv_limits", fx.PIXELS, """
, q as (select video_id, quantile_cont(v, 0.05) as v05, quantile_cont(v, 0.95) as v95, quantile_cont(s, 0.1) as s10, quantile_cont(s, 0.2) as s20, quantile_cont(s, 0.3) as s30, quantile_cont(s, 0.9) as s90 from src group by 1)
select video_id, cast(trunc(s10) as int) as white_s_low, cast(trunc(greatest(v05, 30)) as int) as white_v_low, cast(trunc(least(s90, 60)) as int) as white_s_high, cast(trunc(least(v95, 255)) as int) as white_v_high,
  greatest(30, cast(trunc(s20) as int)) as red_s_low, greatest(40, cast(trunc(s30) as int)) as yellow_s_low, greatest(120, cast(trunc(least(v95, 255) * cast(0.6 as double)) as int)) as yellow_v_low from q""")
def _(df):
    return frames.hsv_limits(df, ["video_id"])


@over("reference_pixels", "select user_id%3 as video_id, cast(event_id%7 as int) as frame_rank, cast(event_id%16 as int) as x, cast(event_id%5 as int) as y, cast((event_id*7919)%256 as int) as s, cast((event_id*104729)%256 as int) as v from events", """
select video_id, x, y, cast(trunc(avg(s)) as int) as s, cast(trunc(avg(v)) as int) as v from src where frame_rank <= 5 group by 1, 2, 3""")
def _(df):
    return frames.reference_pixels(df)


@over("mean_color", f"select event_id%50 as crop_id, b, g, r from ({_COLORS}) c", "select crop_id, round(avg(b), 6) + 0.0 as b, round(avg(g), 6) + 0.0 as g, round(avg(r), 6) + 0.0 as r from src group by 1")
def _(df):
    return frames.mean_color(df, ["crop_id"]).select("crop_id", *(r6(c, c) for c in "bgr"))


@over("color_masks", fx.PIXELS, """
select video_id, count(*) filter (h between 0 and 180 and s between 0 and 30 and v between 180 and 255) as white,
  count(*) filter ((h between 0 and 8 or h between 172 and 180) and s between 80 and 255 and v between 80 and 255) as red, count(*) filter (h between 22 and 34 and s between 100 and 255 and v between 200 and 255) as yellow from src group by 1""")
def _(df):
    m = lambda low, high: frames.in_range(F.col("h"), F.col("s"), F.col("v"), low, high)
    return df.groupBy("video_id").agg(F.count_if(m((0, 0, 180), (180, 30, 255))).alias("white"), F.count_if(m((0, 80, 80), (8, 255, 255)) | m((172, 80, 80), (180, 255, 255))).alias("red"), F.count_if(m((22, 100, 200), (34, 255, 255))).alias("yellow"))


_AIM = """, m as (select *, quantile_cont(n, 0.5) over (partition by video_id order by frame_id rows 29 preceding) as median, row_number() over (partition by video_id order by frame_id) as k from src),
t as (select video_id, frame_id, median, k, case when k >= 5 then cast(case when median < 8 then 0.35 when median > 8.5 then 0.65 else 0.5 end as double) end as target from m)"""


@over("density_target", fx.DENSITY, _AIM + " select video_id, frame_id, median, target from t")
def _(df):
    return frames.target_confidence(df, density_low=8, density_high=8.5).select("video_id", "frame_id", "median", "target")


@over("density_smoothing", fx.DENSITY, _AIM + ", l as (select video_id, list(target order by frame_id) as t from t where target is not null group by 1) select video_id, cast(len(t) as int) as steps, round(list_reduce(list_prepend(cast(0.5 as double), t), lambda a, x: a * cast(0.7 as double) + x * cast(0.3 as double)), 6) as confidence from l")
def _(df):
    got = frames.smoothed(frames.target_confidence(df, density_low=8, density_high=8.5))
    return got.select("video_id", "steps", r6("confidence", "confidence"))


# ---- labels

_GOOD = "cx between 0 and 1 and cy between 0 and 1 and w > 0 and w <= 1 and h > 0 and h <= 1 and cx - w / 2 >= 0 and cx + w / 2 <= 1 and cy - h / 2 >= 0 and cy + h / 2 <= 1"
_VALID = f"(w * h >= cast(0.0005 as double) and w >= cast(0.008 as double) and h >= cast(0.008 as double) and {_GOOD})"
_KEY = "split, file, line_no"


@over("label_parse", fx.LABEL_LINES, r"""
, p as (select *, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') as t from src),
g as (select *, len(t) = 5 and regexp_full_match(t[1], '[+-]?[0-9]+') and try_cast(t[2] as double) is not null and try_cast(t[3] as double) is not null and try_cast(t[4] as double) is not null and try_cast(t[5] as double) is not null as ok from p)
select split, file, line_no, case when ok then cast(t[1] as int) end as cls, case when ok then cast(t[2] as double) end as cx, case when ok then cast(t[3] as double) end as cy,
  case when ok then cast(t[4] as double) end as w, case when ok then cast(t[5] as double) end as h from g""")
def _(df):
    return labels.parse(df).drop("line")


@over("label_validity", fx.LABELS, f"select {_KEY} from src where {_VALID}")
def _(df):
    return df.where(labels.valid()).select("split", "file", "line_no")


@over("label_validity_merge", fx.LABELS, f"select {_KEY} from src where w * h >= cast(0.0005 as double) and {_GOOD}")
def _(df):
    return df.where(labels.valid_for_merge()).select("split", "file", "line_no")


@over("class_area_filter", fx.LABELS, f"select {_KEY} from src where not (cls = 1 and w * h < cast(0.005 as double))")
def _(df):
    return labels.drop_small(df).select("split", "file", "line_no")


_SIG = "cls, round(cx, 6) as a, round(cy, 6) as b, round(w, 6) as c, round(h, 6) as d"


@over("duplicate_signatures", fx.LABELS, f", s as (select *, {_SIG} from src) select split, cls, a as cx, b as cy, c as w, d as h, count(*) as n, min(file) as first_file from s group by 1, 2, 3, 4, 5, 6 having count(*) >= 3")
def _(df):
    return labels.duplicate_signatures(df)


_JUDGED = f""", s as (select *, round(cx, 6) as a, round(cy, 6) as b, round(w, 6) as c, round(h, 6) as d, {_VALID} as ok from src),
n as (select *, count(*) over (partition by split, cls, a, b, c, d) as n, min(file) over (partition by split, cls, a, b, c, d) as f0, row_number() over (partition by split, cls, a, b, c, d, file, ok order by line_no) as rn from s),
j as (select split, file, line_no, cls, cx, cy, w, h, case when not ok then 'small' when not (n < 3 or (file = f0 and rn = 1)) then 'duplicate' end as reason from n)"""


@over("label_dedup", fx.LABELS, _JUDGED + f" select {_KEY}, reason from j")
def _(df):
    return labels.deduplicated(df).select("split", "file", "line_no", "reason")


@over("cleanup_counters", fx.LABELS, _JUDGED + """, k as (select split, file, count(*) as n, count(*) filter (reason = 'small') as small, count(*) filter (reason = 'duplicate') as duplicate, count(*) filter (reason is null) as kept from j group by 1, 2)
select split, cast(sum(n) as bigint) as total, cast(0 as bigint) as invalid, cast(sum(small) as bigint) as small, cast(sum(duplicate) as bigint) as duplicate, count(*) filter (kept = 0) as empty_files, cast(sum(kept) as bigint) as kept from k group by 1""")
def _(df):
    return labels.cleanup_counters(labels.deduplicated(df))


@over("class_counts", fx.LABELS, "select split, cls, count(*) as n from src group by 1, 2")
def _(df):
    return labels.class_counts(df, ["split"])


def _positions(value: str, name: str, places: str = "round({0}, 6) + 0.0") -> str:
    f = lambda x: places.format(x)
    return f"{f('l[1]')} as min_{name}, {f('l[cast(floor(n / 2) as bigint) + 1]')} as median_{name}, {f('l[cast(floor(n * cast(0.9 as double)) as bigint) + 1]')} as p90_{name}, {f('l[n]')} as max_{name}"


@over("area_profile", fx.LABELS, f""", g as (select split, list_sort(list(w * h)) as l, count(*) as n, count(*) filter (w * h < cast(0.001 as double)) as tiny, count(*) filter (w * h >= cast(0.001 as double) and w * h < cast(0.01 as double)) as small,
  count(*) filter (w * h >= cast(0.01 as double) and w * h < cast(0.1 as double)) as medium, count(*) filter (w * h >= cast(0.1 as double)) as large from src group by 1)
select split, n, {_positions('', 'area')}, tiny, small, medium, large from g""")
def _(df):
    got = labels.area_profile(df, ["split"])
    return got.withColumns({c: r6(c) for c in got.columns if c.endswith("_area")})


_PIXEL_LABELS = f"select split, file, line_no, cls, case when line_no = 2 then cx * 480 else cx end as cx, cy, case when line_no = 2 then w * 480 else w end as w, case when line_no = 2 then h * 480 else h end as h from ({fx.LABELS}) l"
_BIG = "(w > 1 or h > 1)"


@over("aspect_profile", _PIXEL_LABELS, f", u as (select split, case when {_BIG} then w / 480 else w end as w, case when {_BIG} then h / 480 else h end as h from src), g as (select split, list_sort(list(w / h)) as l, count(*) as n from u where h > 0 group by 1) select split, n, {_positions('', 'ratio')} from g")
def _(df):
    got = labels.aspect_profile(df, ["split"])
    return got.withColumns({c: r6(c) for c in got.columns if c.endswith("_ratio")})


@over("pixel_share", fx.LABELS, """, g as (select cls, list_sort(list(sqrt(w * h) * 640)) as l, count(*) as n, count(*) filter (sqrt(w * h) * 640 >= 40) as above, round(avg((sqrt(w * h) * 640 >= 40)::int), 6) + 0.0 as share from src group by 1)
select cls, cast(trunc(l[1]) as int) as min_px, cast(trunc(l[cast(floor(n / 2) as bigint) + 1]) as int) as median_px, cast(trunc(l[cast(floor(n * cast(0.9 as double)) as bigint) + 1]) as int) as p90_px, above, share from g""")
def _(df):
    return labels.pixel_share(df, ["cls"]).withColumn("share", r6("share"))


@over("label_normalization", _PIXEL_LABELS, "select split, file, line_no, greatest(cx, cy, w, h) > 1 as normalized, " + ", ".join(f"round(case when greatest(cx, cy, w, h) > 1 then {c} / 480 else {c} end, 6) + 0.0 as {c}" for c in ("cx", "cy", "w", "h")) + " from src")
def _(df):
    got = labels.normalized(df)
    return got.select("split", "file", "line_no", "normalized", *(r6(c, c) for c in labels.COORDS))


@over("label_text", fx.LABELS, "select split, file, line_no, '0 ' || cast(cast(cx as decimal(18, 6)) as varchar) || ' ' || cast(cast(cy as decimal(18, 6)) as varchar) || ' ' || cast(cast(w as decimal(18, 6)) as varchar) || ' ' || cast(cast(h as decimal(18, 6)) as varchar) as line from src")
def _(df):
    return df.select("split", "file", "line_no", labels.label_text(0).alias("line"))


@over("merged_names", f"select distinct split, case when line_no%2 = 0 then file else 'd/' || file end as file from ({fx.LABELS}) l", """
, b as (select *, 'tiled_' || split || '_' || regexp_replace(regexp_replace(file, '^.*/', ''), '[.][^.]*$', '') as base from src), k as (select *, row_number() over (partition by base order by split, file) - 1 as k from b)
select split, file, case when k = 0 then base else base || '_' || k end as name from k""")
def _(df):
    return labels.merged_names(df)


_STEM = "regexp_replace({0}, '[.][^.]*$', '')"
_WITH = f"""with src as ({_PIXEL_LABELS}), img as ({fx.IMAGES}),
i as (select split, {_STEM.format('image')} as stem, min_by(image, case when image like '%.jpg' then 1 else 2 end) as image from img where image like '%.jpg' or image like '%.png' group by 1, 2)"""


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.view(spark, sf_dir, _PIXEL_LABELS), fx.view(spark, sf_dir, fx.IMAGES)


@query("label_images", _WITH + f" select s.split, file, line_no, image from src s join i on i.split = s.split and i.stem = {_STEM.format('file')}")
def _(spark, sf_dir):
    return labels.with_images(*_images(spark, sf_dir)).select("split", "file", "line_no", "image")


_UNIT = f""", m as (select s.split, file, line_no, image, greatest(cx, cy, w, h) > 1 as big, cx, cy, w, h from src s left join i on i.split = s.split and i.stem = {_STEM.format('file')}),
u as (select split, file, line_no, image, big, case when big then cx / 480 else cx end as cx, case when big then cy / 480 else cy end as cy, case when big then w / 480 else w end as w, case when big then h / 480 else h end as h from m),
v as (select *, w * h >= cast(0.0005 as double) and {_GOOD} as ok from u)"""


@query("label_merge", _WITH + _UNIT + " select split, file, line_no, image, big as normalized from v where image is not null and ok")
def _(spark, sf_dir):
    return labels.merge(*_images(spark, sf_dir)).select("split", "file", "line_no", "image", "normalized")


@query("merge_counters", _WITH + _UNIT + """, a as (select split, count(distinct file) as files, count(distinct file) filter (image is not null) as with_image, count(distinct file) filter (image is null) as no_image,
  count(*) filter (image is not null and ok) as copied, count(*) filter (image is not null and not ok) as rejected, count(*) filter (image is not null and big) as normalized from v group by 1) select * from a""")
def _(spark, sf_dir):
    return labels.merge_counters(*_images(spark, sf_dir))


@query("orphan_images", f"with src as ({fx.LABELS}) {_JUDGED}, img as ({fx.IMAGES}), k as (select split, file from j group by 1, 2 having count(*) filter (reason is null) = 0) select img.split, min_by(image, case when image like '%.jpg' then 1 else 2 end) as image from img join k on k.split = img.split and {_STEM.format('image')} = {_STEM.format('file')} where image not like '%.txt' group by img.split, file")
def _(spark, sf_dir):
    judged = labels.deduplicated(fx.view(spark, sf_dir, fx.LABELS))
    return labels.orphan_images(fx.view(spark, sf_dir, fx.IMAGES), judged)


@over("calibration_list", fx.IMAGES, "select image from src where image not like '%.txt' order by image limit 300")
def _(df):
    return df.where(~F.col("image").endswith(".txt")).select("image").orderBy("image").limit(300)


# ---- pixels

_ROW, _COLUMN = "partition by frame_id, y order by x", "partition by frame_id, x order by y"
_CLOSED = "src"
for _along, _fold in ((_ROW, "max"), (_COLUMN, "max"), (_COLUMN, "min"), (_ROW, "min")):
    _CLOSED = f"(select frame_id, y, x, {_fold}(mask) over ({_along} rows between 3 preceding and 3 following) as mask from {_CLOSED})"


@over("closed_mask", fx.PIXEL_GRID, f"select frame_id, y, x, mask from {_CLOSED}")
def _(df):
    return pixels.closed(df, "mask").select("frame_id", "y", "x", "mask")


_OTSU = """, bins as (select frame_id, level, count(*) as n from src group by 1, 2),
sums as (select frame_id, level, cast(sum(n) over so_far as double) as w, cast(sum(level * n) over so_far as double) as m, cast(sum(n) over whole as double) as t, cast(sum(level * n) over whole as double) as every
  from bins window so_far as (partition by frame_id order by level rows unbounded preceding), whole as (partition by frame_id)),
b as (select frame_id, level, case when w < t then (every * w - m * t) * (every * w - m * t) / (w * (t - w)) else 0 end as b from sums),
best as (select frame_id, cast(case when b > 0 then level else 0 end as bigint) as threshold from (select *, row_number() over (partition by frame_id order by b desc, level) as k from b) where k = 1)
"""


@over("otsu_threshold", fx.PIXEL_GRID, _OTSU + "select frame_id, threshold from best")
def _(df):
    return pixels.otsu_threshold(df, "level")


@over("otsu_binary", fx.PIXEL_GRID, _OTSU + "select src.frame_id, y, x, cast(case when level > threshold then 255 else 0 end as int) as level from src join best on best.frame_id = src.frame_id")
def _(df):
    return pixels.otsu(df, "level").select("frame_id", "y", "x", "level")


def _blur_sql(weights: list[float]) -> str:
    made = "(select *, cast(level as double) as v from src)"
    for along in (_ROW, _COLUMN):
        whole = f"({along} rows between unbounded preceding and unbounded following)"
        near = lambda i: f"coalesce({'lag' if i < 0 else 'lead'}(v, {abs(i)}) over ({along}), {'first' if i < 0 else 'last'}_value(v) over {whole})" if i else "v"  # noqa: B023, E731
        made = f"(select * exclude (v), {' + '.join(f'cast({w!r} as double) * {near(i)}' for i, w in enumerate(weights, -(len(weights) // 2)))} as v from {made})"
    return made


@over("adaptive_threshold", fx.PIXEL_GRID, f"select frame_id, y, x, cast(case when level > floor(round(v, 6) + 0.5) - 2 then 255 else 0 end as int) as level from {_blur_sql(pixels.gaussian_weights(11))}")
def _(df):
    return pixels.adaptive_threshold(df, "level").select("frame_id", "y", "x", "level")


@over("box_threshold", fx.PIXEL_GRID, """select a.frame_id, a.y, a.x, cast(case when any_value(a.level) > floor(round(avg(b.level), 6) + 0.5) - 2 then 255 else 0 end as int) as level
from src a join src b on a.frame_id = b.frame_id and b.x between a.x - 5 and a.x + 5 and b.y between a.y - 5 and a.y + 5 group by 1, 2, 3""")
def _(df):
    return pixels.adaptive_threshold(df, "level", smooth=False).select("frame_id", "y", "x", "level")


def _laplace_sql(along: str) -> str:
    before, after = f"lag(level) over ({along})", f"lead(level) over ({along})"
    return f"coalesce({before}, {after}, level) + coalesce({after}, {before}, level) - 2 * level"


@over("blur_gate", fx.PIXEL_GRID, f"""select frame_id, max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height, round(var_pop(cast(l as double)), 6) as blur, max(x) >= 31 and max(y) >= 15 and var_pop(cast(l as double)) >= 8000 as readable
from (select *, {_laplace_sql(_ROW)} + {_laplace_sql(_COLUMN)} as l from src) group by frame_id""")
def _(df):
    return pixels.readable(pixels.sharpness(df, "level", ("frame_id",)), 32, least_blur=8000).withColumn("blur", r6("blur", "blur"))


@over("equalized_levels", fx.PIXEL_GRID, """, shape as (select frame_id, cast(ceil((max(x) + 1) / 8) as bigint) as xs, cast(ceil((max(y) + 1) / 8) as bigint) as ys, max(x) + 1 as w, max(y) + 1 as h from src group by 1),
p as (select src.*, xs, ys, w, h, x // xs as xt, y // ys as yt from src join shape on shape.frame_id = src.frame_id),
c as (select frame_id, xt, yt, level, count(*) as n from p group by 1, 2, 3, 4), area as (select frame_id, xt, yt, sum(n) as area from c group by 1, 2, 3),
bins as (select a.frame_id, a.xt, a.yt, l.level, area, coalesce(n, 0) as n, greatest(cast(floor(3.0 * area / 256) as bigint), 1) as cut from area a cross join (select unnest(range(256)) as level) l
  left join c on c.frame_id = a.frame_id and c.xt = a.xt and c.yt = a.yt and c.level = l.level),
o as (select *, sum(greatest(n - cut, 0)) over (partition by frame_id, xt, yt) as over_ from bins),
d as (select *, greatest(256 // greatest(over_ % 256, 1), 1) as step from o),
e as (select frame_id, xt, yt, level, area, least(n, cut) + over_ // 256 + case when level % step = 0 and level // step < over_ % 256 then 1 else 0 end as n from d),
maps as (select frame_id, xt, yt, level, round_even(sum(n) over (partition by frame_id, xt, yt order by level rows unbounded preceding) * cast(255 as double) / area, 0) as t from e),
f as (select frame_id, y, x, level, cast(x as double) / xs - 0.5 as fx, cast(y as double) / ys - 0.5 as fy, (w - 1) // xs as lx, (h - 1) // ys as ly from p),
g as (select *, greatest(floor(fx), 0) as x0, least(floor(fx) + 1, lx) as x1, greatest(floor(fy), 0) as y0, least(floor(fy) + 1, ly) as y1, fx - floor(fx) as ax, fy - floor(fy) as ay from f),
four as (select frame_id, y, x, level, unnest([{'xt': x0, 'yt': y0, 'w': (1 - ax) * (1 - ay)}, {'xt': x1, 'yt': y0, 'w': ax * (1 - ay)}, {'xt': x0, 'yt': y1, 'w': (1 - ax) * ay}, {'xt': x1, 'yt': y1, 'w': ax * ay}]) as c from g)
select four.frame_id, y, x, cast(floor(round(sum(c.w * t) / sum(c.w), 6) + 0.5) as int) as level from four join maps on maps.frame_id = four.frame_id and maps.xt = c.xt and maps.yt = c.yt and maps.level = four.level group by 1, 2, 3""")
def _(df):
    return pixels.equalized(df.select("frame_id", "y", "x", "level"), "level")


@over("mask_regions", fx.PIXEL_GRID, f"""with recursive src as ({fx.PIXEL_GRID}), p as (select frame_id, y, x, y * 32 + x as n from src where mask > 0),
e as (select a.frame_id, a.n as a, b.n as b from p a join p b on a.frame_id = b.frame_id and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1),
r as (select frame_id, n, n as root from p union select e.frame_id, e.b, r.root from r join e on e.frame_id = r.frame_id and e.a = r.n),
m as (select frame_id, n, min(root) as root from r group by 1, 2)
select p.frame_id, cast(min(x) as bigint) as x1, cast(min(y) as bigint) as y1, cast(max(x) + 1 as bigint) as x2, cast(max(y) + 1 as bigint) as y2, count(*) as pixels from p join m on m.frame_id = p.frame_id and m.n = p.n group by p.frame_id, root""")
def _(df):
    return pixels.regions(df, "mask", stripe=8)


@over("mask_axis", fx.PIXEL_GRID, """select frame_id, count(*) as pixels, round(avg(x), 6) as mid_x, round(avg(y), 6) as mid_y, round(degrees(atan2(2 * covar_pop(cast(x as double), cast(y as double)), var_pop(cast(x as double)) - var_pop(cast(y as double)))) / 2, 6) as angle
from src where mask > 0 group by 1""")
def _(df):
    return pixels.principal_axis(df, "mask").withColumns({c: r6(c, c) for c in ("mid_x", "mid_y", "angle")})


# ---- tracking

_FRAMES_OF = f"select v.video_id, f.frame_id from (select distinct video_id from ({fx.TDET}) t) v cross join (select explode(sequence(cast(0 as bigint), cast(99 as bigint))) as frame_id) f"
_SOLO = config.Tracker(1.0, 0.25, 15)
_TRACKS = f"""with src as ({fx.TDET}), g as (select *, frame_id - lag(frame_id) over (partition by video_id, det_ord order by frame_id) - 1 as gap from src),
k as (select *, sum(case when gap is null or gap > 15 then 1 else 0 end) over (partition by video_id, det_ord order by frame_id) as part from g),
t as (select video_id, det_ord, part, min(frame_id) as first_frame, max(frame_id) as last_frame, count(*) as boxes, max(conf) as max_conf from k group by 1, 2, 3),
n as (select *, row_number() over (partition by video_id order by first_frame, det_ord) - 1 as track_id from t)
"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.view(spark, sf_dir, fx.TDET).withColumn("tag_type", F.lit("yolo"))
    return tracking.track(found, fx.view(spark, sf_dir, _FRAMES_OF), _SOLO)


@query("track", _TRACKS + "select k.video_id, k.frame_id, k.det_ord, n.track_id, k.frame_id = n.first_frame as is_new, n.first_frame as first_seen, max(k.conf) over (partition by k.video_id, n.track_id order by k.frame_id rows unbounded preceding) as conf from k join n on n.video_id = k.video_id and n.det_ord = k.det_ord and n.part = k.part")
def _(spark, sf_dir):
    return _tracks(spark, sf_dir).where("matched").select("video_id", "frame_id", "det_ord", "track_id", "is_new", "first_seen", "conf")


@query("track_summary", _TRACKS + "select video_id, track_id, first_frame, last_frame, boxes, max_conf from n")
def _(spark, sf_dir):
    return tracking.summary(_tracks(spark, sf_dir))


_EMIT = _TRACKS + """, a as (select n.video_id, n.track_id, first_frame, last_frame, unnest(range(first_frame, least(last_frame + 15, 99) + 1)) as frame_id, det_ord, part from n),
s as (select a.*, (select max(k.frame_id) from k where k.video_id = a.video_id and k.det_ord = a.det_ord and k.part = a.part and k.frame_id <= a.frame_id) as last_seen,
  (select max(k.conf) from k where k.video_id = a.video_id and k.det_ord = a.det_ord and k.part = a.part and k.frame_id <= a.frame_id) as conf from a)
"""


@query("track_emission", _EMIT + "select video_id, frame_id, track_id, frame_id > first_frame as tracked, round(case when frame_id > first_frame then least(conf * (1 + least((last_seen - first_frame) * cast(0.03 as double), cast(1.3 as double) - 1)), 1) else conf end, 6) + 0.0 as conf, cast(frame_id - last_seen as int) as missed from s")
def _(spark, sf_dir):
    return tracking.emitted(_tracks(spark, sf_dir)).select("video_id", "frame_id", "track_id", "tracked", r6("conf", "conf"), "missed")


@query("track_counters", _EMIT + "select video_id, count(*) filter (frame_id > first_frame) as tracked_hits, count(*) filter (frame_id = first_frame) as new_tracks, count(*) filter (frame_id = 99) as active_tags from s group by 1")
def _(spark, sf_dir):
    return tracking.counters(_tracks(spark, sf_dir))


@query("sure_tracks", _EMIT + "select video_id, frame_id, bool_or(last_seen - first_frame >= 3 and last_seen = frame_id) as sure from s group by 1, 2")
def _(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return t.groupBy("video_id", "frame_id").agg(F.bool_or((F.col("last_seen") - F.col("first_seen") >= 3) & (F.col("missed") == 0)).alias("sure"))


@over("frame_rate", fx.FRAME_TIMES, """, n as (
  select video_id, frame_id, row_number() over w as frames, done_at - min(done_at) over w as elapsed from src window w as (partition by video_id order by frame_id rows between unbounded preceding and current row)
) select video_id, frame_id, cast(frames as bigint) as frames, round(elapsed, 6) as elapsed, round(case when elapsed > 0 then frames / elapsed else 0 end, 6) as per_second from n where frames%10 = 0""")
def _(df):
    return frames.frame_rate(df, "video_id", "frame_id", "done_at").select("video_id", "frame_id", "frames", r6("elapsed", "elapsed"), r6("per_second", "per_second"))


def _cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = fx.view(spark, sf_dir, fx.DET).withColumn("video_id", F.floor(F.col("frame_id") / 100)).withColumn("tag_type", F.lit(""))
    sizes = fx.view(spark, sf_dir, fx.FRAMES).withColumn("video_id", F.floor(F.col("frame_id") / 100))
    return tracking.cascade(found, sizes), sizes


@query("frame_pipeline")
def _(spark, sf_dir):
    """Merging, model gating and tracking together; the state cannot be put in SQL, so a simulation tests it."""
    return _cascade(spark, sf_dir)[0]


@query("frame_results")
def _(spark, sf_dir):
    """What the frame pipeline gives for every frame, with each tag's reading; tested by the same simulation."""
    tracks, sizes = _cascade(spark, sf_dir)
    return tracking.results(tracks, fx.view(spark, sf_dir, fx.FRAME_LINES), sizes)


@query("frame_density")
def _(spark, sf_dir):
    """The confidence that the frame pipeline aims at, frame by frame; tested by the same simulation."""
    return tracking.aimed_confidence(*_cascade(spark, sf_dir))


@over("pixel_candidates", fx.COLOR_GRID)  # regions and suppression in one: tests/test_detection.py holds it against plain Python
def _(df):
    return detection.detect(df, size=3, min_w=3, min_h=2)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql}

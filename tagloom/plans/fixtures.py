"""Detection-shaped views derived from the given tables; each statement runs in Spark SQL and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DET = """
select det_id, frame_id, det_ord, x1, y1, x1+w as x2, y1+h as y2, conf, source from (
  select event_id as det_id, cast(floor(event_id/20) as bigint) as frame_id, cast(event_id%20 as int) as det_ord,
    cast((event_id%4)*110+(event_id*7919)%61 as double) as x1, cast(20+(event_id*104729)%37 as double) as y1,
    cast(60+(event_id*31)%40 as double) as w, cast(50+(event_id*17)%30 as double) as h,
    cast(((event_id*613)%12)*7+15 as double)/100 as conf,
    case when event_id%3=0 then 'yolo' else 'color' end as source
  from events) t
"""
TDET = """
select * from (select cast(floor(event_id/1000) as bigint) as video_id, cast(floor((event_id%1000)/10) as bigint) as frame_id, cast(event_id%10 as int) as det_ord,
  cast((event_id%10)*300+(cast(floor((event_id%1000)/10) as bigint)*7+(event_id%10)*13)%11 as double) as x1,
  cast(50+(cast(floor((event_id%1000)/10) as bigint)*5)%7 as double) as y1,
  cast((event_id%10)*300+(cast(floor((event_id%1000)/10) as bigint)*7+(event_id%10)*13)%11+100 as double) as x2,
  cast(130+(cast(floor((event_id%1000)/10) as bigint)*5)%7 as double) as y2,
  cast((event_id*613)%86+15 as double)/100 as conf, (event_id*31)%7 as drop_key from events) t
where drop_key<>0 and not (det_ord=3 and frame_id between 20 and 40) and not (det_ord=5 and frame_id between 50 and 64)
"""
OCR_LINES = """
select p_partkey as crop_id, 0 as line_no, p_name || ' ' || p_brand as text from part
union all select p_partkey, 1, cast((p_partkey*7919)%100000 as string) || ',' || lpad(cast((p_partkey*31)%100 as string),2,'0') || ' rub' from part
union all select p_partkey, 2, '-' || cast(p_partkey%60 as string) || '% off' from part where p_partkey%3=0
union all select p_partkey, 3, lpad(cast(p_partkey%28+1 as string),2,'0') || '.' || lpad(cast(p_partkey%12+1 as string),2,'0') || '.2025' from part where p_partkey%4=0
union all select p_partkey, 4, 'code ' || lpad(cast(p_partkey*7919 as string),13,'4') || ' end' from part
"""
QR = """
select p_partkey as crop_id, case p_partkey%4
  when 0 then '{"price": "' || cast(p_size as string) || '.50", "sku": "' || lpad(cast(p_partkey as string),9,'1') || '"}'
  when 1 then 'price=' || cast(p_size as string) || '.25;sku=' || lpad(cast(p_partkey as string),9,'2')
  when 2 then 'a' || cast(p_partkey as string) || '|b|c'
  else 'plain text ' || cast(p_size as string) || '.75' end as raw from part
"""
CATALOG = """
select p_partkey as row_no, p_name || ' ' || p_brand as fullname,
  case p_partkey%3 when 0 then cast(p_partkey%500 as string) when 1 then lpad(cast(p_partkey%500 as string),13,'0') else '4600' || lpad(cast(p_partkey as string),9,'0') end as code from part
"""
LABELS = """
select case when event_id%5=0 then 'val' else 'train' end as split, 'f' || lpad(cast(cast(floor(event_id/7) as bigint) as string),6,'0') || '.txt' as file, cast(event_id%7 as int) as line_no,
  cast(event_id%2 as int) as cls, case when event_id%3=0 then cast((event_id*37)%50 as double)/50 else cast((event_id*7919)%9973 as double)/9973 end as cx, cast((event_id*11)%40 as double)/40 as cy,
  cast((event_id*13)%20 as double)/100 as w, cast((event_id*7)%25 as double)/100 as h from events
"""
#: Coloured boxes for candidates: each frame's boxes dealt to three colours.
COLORED = f"""
select frame_id, det_ord, x1, y1, x2, y2, case det_id%3 when 0 then 'red' when 1 then 'white' else 'yellow' end as color from ({DET}) d
"""
#: Frames of the detection view, with a size.
FRAMES = f"select distinct frame_id, cast(640 + 320*(frame_id%5) as int) as frame_w, cast(480 + 240*(frame_id%4) as int) as frame_h from ({DET}) d"
#: Raw predictions: centre boxes, objectness and three class scores.
PREDICTIONS = f"""
select frame_id, det_ord, (x1+x2)/2 as cx, (y1+y2)/2 as cy, x2-x1 as w, y2-y1 as h, conf as obj,
  cast((det_id*7)%10 as double)/10 as s0, cast((det_id*3)%11 as double)/11 as s1, cast((det_id*5)%13 as double)/13 as s2 from ({DET}) d
"""
#: OCR lines with a confidence and an image variant.
VARIANTS = f"""
select crop_id, line_no, cast((crop_id+line_no)%2 as int) as variant, cast((crop_id*31+line_no*17)%100 as double)/100 as conf, text from ({OCR_LINES}) o
"""
#: Label lines as text, some of them broken.
LABEL_LINES = """
select case when event_id%5=0 then 'val' else 'train' end as split, 'f' || lpad(cast(cast(floor(event_id/7) as bigint) as string),6,'0') || '.txt' as file, cast(event_id%7 as int) as line_no,
  case event_id%11 when 0 then cast(event_id%3 as string) || ' 0.5 0.5' when 1 then 'x 0.5 0.5 0.1 0.1' when 2 then '' when 3 then '1 0.5 a 0.1 0.1'
    when 4 then '1.5 0.5 0.5 0.1 0.1' when 5 then '  ' || cast(event_id%3 as string) || '  0.25 0.5   0.125 0.1 ' when 6 then cast(event_id%2 as string) || ' 240 120 48 24'
    else cast(event_id%2 as string) || ' 0.' || cast(event_id%97+1 as string) || ' 0.5 0.2 0.' || lpad(cast(event_id%40+1 as string),2,'0') end as line from events
"""
#: Images of the labelled files: some missing, some twice, one in another form of name.
IMAGES = """
select distinct case when event_id%5=0 then 'val' else 'train' end as split, 'f' || lpad(cast(cast(floor(event_id/7) as bigint) as string),6,'0') ||
  case event_id%3 when 0 then '.jpg' when 1 then '.png' else '.txt' end as image from events where cast(floor(event_id/7) as bigint)%4 <> 0
"""
#: Export rows by tracker, filled differently.
TRACK_ROWS = """
select event_id as arrival, case when event_id%9=0 then '' else cast(event_id%40 as string) end as tracker_id, 'v' || cast(event_id%3 as string) as filename,
  case when event_id%2=0 then cast(event_id%1000 as string) || '.50' else '' end as price_default, case when event_id%5=0 then lpad(cast(event_id*7919 as string),13,'4') else '' end as barcode,
  case when event_id%7=0 then 'name ' || cast(event_id as string) else '' end as product_name from events
"""
#: Values to validate, good and bad.
CHECK_ROWS = """
select event_id as arrival, case event_id%5 when 0 then '-1.50' when 1 then 'abc' when 2 then '10000000' when 3 then cast(event_id as string) || '.99' else '' end as price_default,
  case event_id%4 when 0 then '12345' when 1 then '4600-644-11000-' || cast(event_id%10 as string) when 2 then cast(event_id+10000000 as string) else '' end as barcode,
  case event_id%6 when 0 then '-5' when 1 then 'x' when 2 then '' else cast(event_id%300 as string) end as x_min, cast(event_id%100 as string) as y_min,
  cast(event_id%200+100 as string) as x_max, cast(event_id%100+20 as string) as y_max from events
"""
#: Values read of a track over time.
TRACK_TEXTS = """
select event_id%50 as track_id, event_id as ord, case event_id%3 when 0 then 'name' when 1 then 'sku' else 'price' end as key,
  case when event_id%11=0 then '' else substr('abcdefghijklmnopqrstuvwxyz', 1, cast((event_id*7)%9+1 as int)) || cast(event_id%10 as string) end as value from events
"""
#: Detections per frame of a few videos.
DENSITY = "select user_id%7 as video_id, event_id as frame_id, cast((event_id*37)%17 as int) as n from events"
#: When frames of a few videos were done, in seconds.
FRAME_TIMES = "select user_id%7 as video_id, event_id as frame_id, cast(floor(event_id/32) as double)/8 as done_at from events"
#: Pixels of a few frames.
PIXELS = "select event_id%6 as video_id, event_id as pixel_id, cast((event_id*7919)%256 as int) as s, cast((event_id*104729)%256 as int) as v, cast((event_id*31)%181 as int) as h from events"
#: Dense frames of 32 by 32 pixels: a level and a sparse mask.
PIXEL_GRID = """
select frame_id, y, x, cast(case when (cast(floor((x+frame_id)/6) as int)+cast(floor(y/5) as int))%2=0 then 60 else 170 end + (event_id*7919)%61 - 30 as int) as level,
  cast(case when (event_id*7919+frame_id*131+y*y*17)%101 < 26 then 255 else 0 end as int) as mask from (
  select event_id, cast(floor(event_id/1024) as bigint) as frame_id, cast(floor((event_id%1024)/32) as int) as y, cast(event_id%32 as int) as x from events) e
"""
#: What can be read in the frames of the detection view: a line in the middle of some boxes.
FRAME_LINES = f"""
select cast(floor(frame_id/100) as bigint) as video_id, frame_id, det_ord as line_no, floor((x1+x2)/2) as x, floor((y1+y2)/2) as y,
  case when det_id%4=0 then '' else cast(det_id%900 as string) || '.50 rub ' || cast(det_id%17 as string) end as text from ({DET}) d where det_id%37 = 0
"""
#: Colours of dense frames of 32 by 32 pixels, six frames a video: blocks of white, red and yellow on grey.
COLOR_GRID = """
select video_id, frame_id, y, x, cast(case when kind=1 then 3+noise%4 when kind=2 then 28 else 90 end as int) as h, cast(case when kind=0 then 8+noise%12 when kind=3 then 60+noise%30 else 150+noise%40 end as int) as s,
  cast(case when kind=0 then 200+noise%40 when kind=3 then 70+noise%50 else 210+noise%30 end as int) as v from (
  select video_id, frame_id, y, x, noise, case when (y+frame_id)%16 < 9 and (x+video_id)%11 < 8 then (cast(floor((y+frame_id)/16) as int)*3+cast(floor((x+video_id)/11) as int)+frame_id)%3 else 3 end as kind from (
  select cast(floor(event_id/6144) as bigint) as video_id, cast(floor(event_id/1024) as bigint) as frame_id, cast(floor((event_id%1024)/32) as int) as y, cast(event_id%32 as int) as x, (event_id*7919)%101 as noise from events) e) k
"""
TABLES = ("events", "part")


def view(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over the tables of a folder, without touching the session's views of other folders."""
    text = statement
    for name in TABLES:
        text = text.replace(f" from {name}", f" from parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(text)

"""The interleaved tuple log: one line for each insert, `sid|1,c1,c2,...`.

A line that begins with `-` is a report marker, `d sid n` pops the n oldest rows of a stream,
an empty line ends the input.  Each line keeps its arrival number (``seq``, its place in the
file), so that prefixes and deletions are plain filters.  Fields are parsed by explicit
schemas; an empty field is null (it joins nothing), 0 is an ordinary value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime

GRAPH = "src int, dst int"
CUSTOMER = "c_customer_sk int, c_customer_id string, c_current_cdemo_sk int, c_current_hdemo_sk int"
HD = "hd_demo_sk int, hd_income_band_sk int, hd_buy_potential string, hd_dep_count int, hd_vehicle_count int"
DATE = "d_date_sk int, d_date_id string, d_date string, d_month_seq int, d_week_seq int, d_quarter_seq int, d_year int, d_dow int, d_moy int, d_dom int, d_qoy int"
SALES = "ss_sold_date_sk int, ss_sold_time_sk int, ss_item_sk int, ss_customer_sk int, ss_cdemo_sk int, ss_hdemo_sk int, ss_addr_sk int, ss_store_sk int, ss_promo_sk int, ss_ticket_number int, ss_quantity int, ss_item_sk_with_ticket_number bigint"
RETURNS = "sr_returned_date_sk int, sr_return_time_sk int, sr_item_sk int, sr_customer_sk int, sr_cdemo_sk int, sr_hdemo_sk int, sr_addr_sk int, sr_store_sk int, sr_reason_sk int, sr_ticket_number int, sr_item_sk_with_ticket_number bigint"
CATALOG = (
    "cs_sold_date_sk int, cs_sold_time_sk int, cs_ship_date_sk int, cs_bill_customer_sk int, cs_bill_cdemo_sk int, cs_bill_hdemo_sk int, cs_bill_addr_sk int, cs_ship_customer_sk int, cs_ship_cdemo_sk int,"
    " cs_ship_hdemo_sk int, cs_ship_addr_sk int, cs_call_center_sk int, cs_catalog_page_sk int, cs_ship_mode_sk int, cs_warehouse_sk int, cs_item_sk int, cs_promo_sk int, cs_order_number int"
)
ITEM = (
    "i_item_sk int, i_item_id string, i_rec_start_date string, i_rec_end_date string, i_item_desc string, i_current_price double, i_wholesale_cost double, i_brand_id int, i_brand string,"
    " i_class_id int, i_class string, i_category_id int, i_category string, i_manufact_id int, i_manufact string"
)
NAMED = "id bigint, name string, url string"
PERSON = "id bigint, first_name string, last_name string, gender string, birthday string, location_ip string, browser_used string, location_city_id bigint"
TAG = f"{NAMED}, type_tag_class_id bigint"
PLACE = f"{NAMED}, part_of_place_id bigint"
HAS_TAG = "message_id bigint, tag_id bigint"

#: Stream ids of each query's log: relation name and schema.
STREAMS: dict[str, list[tuple[str, str]]] = {
    "qx": [("sr", RETURNS), ("cs", CATALOG), ("d1", DATE), ("d2", DATE), ("ss", SALES)],
    "qy": [("ss", SALES), ("c2", CUSTOMER), ("hd1", HD), ("hd2", HD), ("c1", CUSTOMER)],
    "qz": [("ss", SALES), ("c2", CUSTOMER), ("i2", ITEM), ("hd1", HD), ("hd2", HD), ("c1", CUSTOMER), ("i1", ITEM)],
    "q10": [
        ("tag_class", f"{NAMED}, subclass_of_tag_class_id bigint"), ("tag1", TAG), ("tag2", TAG), ("country", PLACE), ("city", PLACE),
        ("message", "id bigint, location_ip string, browser_used string, content string, length bigint, creator_person_id bigint"),
        ("has_tag1", HAS_TAG), ("has_tag2", HAS_TAG), ("person1", PERSON), ("person2", PERSON), ("knows", "person1_id bigint, person2_id bigint"),
    ],
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, kind, sid, payload): kind is insert, delete (payload: how many) or report.

    seq is the byte-order place of the line: files are read in pieces, and each piece's lines are numbered after those
    of the pieces before it, without bringing the file to one task.  Lines from the first empty one on are left out.
    """
    runtime.prepare(spark)
    lines = spark.read.text(path)
    numbered = runtime.cut(lines.select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))
    end = numbered.where("line = ''").agg(F.min("at").alias("__end"))
    numbered = numbered.crossJoin(F.broadcast(end)).where("__end is null or at < __end").drop("__end")
    per_piece = numbered.groupBy(F.shiftright("at", 33).alias("piece")).agg(F.count(F.lit(1)).alias("n"))
    base = per_piece.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("base"))  # a row for each piece of the file
    placed = numbered.withColumn("piece", F.shiftright("at", 33)).join(F.broadcast(base), "piece")
    seq = (F.col("base") + (F.col("at") - F.shiftleft("piece", 33)) + 1).alias("seq")
    return placed.select(seq, *fields("line"))


DELETE, INSERT = r"^d\s+(\d+)\s+(\d+)\s*$", r"^\s*(\d+)\|[^,]*,(.*)$"


def fields(line: str) -> list[Column]:
    """kind, sid and payload of a line, for files and streams alike."""
    c = F.col(line)
    deletion = F.regexp_extract(c, DELETE, 1)
    kind = F.when(c.startswith("-"), "report").when(deletion != "", "delete").otherwise("insert")
    sid = F.when(kind == "delete", deletion).when(kind == "insert", F.regexp_extract(c, INSERT, 1))
    payload = F.when(kind == "delete", F.regexp_extract(c, DELETE, 2)).when(kind == "insert", F.regexp_extract(c, INSERT, 2))
    return [kind.alias("kind"), sid.try_cast("int").alias("sid"), payload.alias("payload")]


def stream(log: DataFrame, sid: int, schema: str) -> DataFrame:
    """The rows of one stream, parsed, with seq; rows that later delete commands pop are left out."""
    rows = log.where((F.col("kind") == "insert") & (F.col("sid") == sid)).select("seq", F.from_csv("payload", schema, {"mode": "PERMISSIVE"}).alias("row")).select("seq", "row.*")
    return rows


def live(log: DataFrame, rows: DataFrame, sid: int) -> DataFrame:
    """rows of stream sid that are left after the log's delete commands: each pops the oldest rows that are there by then.

    After a delete, min(popped before + n, inserted before it) rows are popped in all.
    """
    marks = log.where((F.col("sid") == sid) & F.col("kind").isin("insert", "delete")).select("seq", F.when(F.col("kind") == "delete", F.col("payload").cast("bigint")).otherwise(0).alias("n"), (F.col("kind") == "insert").cast("bigint").alias("one"))
    deletes = marks.where("n > 0")
    if not deletes.limit(1).count():
        return rows
    # popped in all: the sum of all n, or less where some delete found fewer rows than it was to pop
    ins = marks.where("one = 1").select("seq", F.shiftright("seq", 16).alias("piece"))
    pieces = ins.groupBy("piece").count()  # a row for 65,536 lines
    d = deletes.select("seq", "n", F.shiftright("seq", 16).alias("piece"))
    within = d.join(ins.withColumnRenamed("seq", "at"), "piece", "left").groupBy("seq", "n", "piece").agg(F.count(F.when(F.col("at") < F.col("seq"), 1)).alias("within"))
    ahead = d.select("seq", "piece").join(pieces.select(F.col("piece").alias("p"), "count"), F.col("p") < F.col("piece"), "left").groupBy("seq").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("ahead"))
    before = within.join(ahead, "seq").select("seq", "n", (F.col("within") + F.col("ahead")).alias("inserted"))
    total = before.withColumn("all", F.sum("n").over(Window.orderBy("seq")))  # delete commands only
    popped = total.agg(F.least(F.max("all"), F.min(F.col("inserted") - F.col("all")) + F.max("all")).alias("popped")).first()[0]
    from ..operators.windows import pop_front

    return pop_front(rows, ["seq"], int(popped))


def graph(log: DataFrame, k: int) -> list[DataFrame]:
    """The k copies of the edge relation."""
    return [live(log, stream(log, i, GRAPH), i).drop("seq") for i in range(k)]


def relations(log: DataFrame, query: str) -> dict[str, DataFrame]:
    return {name: live(log, stream(log, i, schema), i).drop("seq") for i, (name, schema) in enumerate(STREAMS[query])}


def write(rows: list[tuple[int, DataFrame, str]], path: str) -> None:
    """Streams as one log in the order of their seq column: (sid, rows with seq, sequence column)."""
    out = None
    for sid, df, seq in rows:
        cols = [c for c in df.columns if c != seq]
        line = F.concat(F.lit(f"{sid}|1,"), F.to_csv(F.struct(*cols)))
        part = df.select(F.col(seq).alias("seq"), F.lit(sid).alias("sid"), line.alias("value"))
        out = part if out is None else out.unionByName(part)
    out.orderBy("seq", "sid", "value").select("value").write.text(path)

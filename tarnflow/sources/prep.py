"""Preparation of inputs: graphs into shuffled streams, social-network tables into one event order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import priority


def graph_streams(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(sid, src, dst, shuffle): each edge once for each of n streams; ordering by shuffle gives the arrival order.

    The order is a function of the seed; repartitionByRange("shuffle") writes it in parallel.
    """
    copies = edges.select("src", "dst").crossJoin(F.broadcast(edges.sparkSession.range(n).select(F.col("id").cast("int").alias("sid"))))
    return copies.select("sid", "src", "dst", priority(seed, "sid", "src", "dst").alias("shuffle"))


def both_directions(knows: DataFrame, a: str = "person1_id", b: str = "person2_id") -> DataFrame:
    """Acquaintance is stored both ways."""
    return knows.select(a, b).unionByName(knows.select(F.col(b).alias(a), F.col(a).alias(b)))


def messages(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts and comments as one relation (all rows of both)."""
    return posts.unionByName(comments, allowMissingColumns=True)


def epoch_millis(ts: str):
    """A date string or timestamp (UTC) as milliseconds."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def event_order(static: list[tuple[int, DataFrame]], dynamic: list[tuple[int, DataFrame, str]]) -> DataFrame:
    """(sid, at, phase, payload): static tables first, then dynamic rows by creation time; order by phase, at, sid, payload."""
    parts = [df.select(F.lit(sid).alias("sid"), F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("phase"), F.to_csv(F.struct(*df.columns)).alias("payload")) for sid, df in static]
    parts += [df.select(F.lit(sid).alias("sid"), epoch_millis(ts).alias("at"), F.lit(1).alias("phase"), F.to_csv(F.struct(*[c for c in df.columns if c != ts])).alias("payload")) for sid, df, ts in dynamic]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SIDS = {"tag_class": 0, "tag1": 1, "tag2": 2, "country": 3, "city": 4, "message": 5, "has_tag1": 6, "has_tag2": 7, "person1": 8, "person2": 9, "knows": 10}


def social_events(tables: dict[str, DataFrame]) -> DataFrame:
    """(sid, at, phase, payload) of a social network's tables with their usual columns, each table in all of its roles.

    tables: tag_class, tag, place (with type), post, comment, post_has_tag, comment_has_tag, person, knows.
    Static ones come first; the others are in the order of creation; acquaintance goes both ways.
    """
    c = lambda df, *names: df.select(*[F.expr(n) for n in names])
    tag = c(tables["tag"], "id", "name", "url", "TypeTagClassId")
    place = lambda kind: c(tables["place"].where(F.col("type") == kind), "id", "name", "url", "PartOfPlaceId")
    static = [(SIDS["tag_class"], c(tables["tag_class"], "id", "name", "url", "SubclassOfTagClassId")), (SIDS["tag1"], tag), (SIDS["tag2"], tag), (SIDS["country"], place("Country")), (SIDS["city"], place("City"))]
    note = ("creationDate", "id", "locationIP", "browserUsed", "content", "length", "CreatorPersonId")
    has_tag = c(tables["post_has_tag"], "creationDate", "PostId as id", "TagId").unionByName(c(tables["comment_has_tag"], "creationDate", "CommentId as id", "TagId"))
    person = c(tables["person"], "creationDate", "id", "firstName", "lastName", "gender", "birthday", "locationIP", "browserUsed", "LocationCityId")
    knows = c(tables["knows"], "creationDate", "Person1Id as a", "Person2Id as b").unionByName(c(tables["knows"], "creationDate", "Person2Id as a", "Person1Id as b"))
    dynamic = [(SIDS["message"], messages(c(tables["post"], *note), c(tables["comment"], *note))), (SIDS["has_tag1"], has_tag), (SIDS["has_tag2"], has_tag), (SIDS["person1"], person), (SIDS["person2"], person), (SIDS["knows"], knows)]
    return event_order(static, [(sid, df, "creationDate") for sid, df in dynamic])


def event_lines(events: DataFrame, markers: int = 10) -> DataFrame:
    """(phase, at, seq, value): the lines of a tuple log; with markers, a report marker after each such share of the dynamic rows.

    Ordered by phase, at, seq they are the log; writing them so is a range-partitioned sort.
    """
    line = F.concat(F.col("sid").cast("string"), F.lit("|1,"), F.col("payload"))
    rows = events.select("phase", "at", F.concat_ws("|", F.lpad(F.col("sid").cast("string"), 3, "0"), "payload").alias("seq"), line.alias("value"))
    if not markers:
        return rows
    from ..operators.access import Access
    from ..plans.spec import JoinSpec, Relation

    dynamic = rows.where("phase = 1")
    order = Access(JoinSpec({"row": Relation(dynamic, ("at", "seq"))}, []))
    step = -(-order.size // markers) + 1
    spark = events.sparkSession
    ends = spark.range(step - 1, order.size, step).toDF("position")
    marks = order.at(ends).select(F.lit(1).alias("phase"), F.col("row__at").alias("at"), F.concat(F.col("row__seq"), F.lit("|")).alias("seq"), F.lit("-").alias("value"))
    return rows.unionByName(marks)

"""Repeated runs of lines, by a suffix array over line ids.

The corpus is one sequence of line ids, document after document.  Suffixes that begin with the
same h lines are an interval of the suffix array whose longest common prefix is at least h.  It is
named by its first member (the one with the least place in the corpus): which of two continuations sorts
first decides nothing here, and sorting all continuations of a hot line would take one task.
A doubling step parts each interval by the name of the suffix h lines further on, which gives
the intervals for 2h lines.  Only suffixes that still share theirs go on; a line that occurs once in
the corpus, and the end of a document, tie with nothing.  Steps go on until no two suffixes
tie, so the number of steps is the logarithm of the longest repeat.

A suffix that isn't the first of its interval is a later copy of h lines.  How far it goes on
beyond the largest such h, the descent finds: with steps h/2, h/4, ... 1 the members of an
interval part by the name of what follows; those that aren't the first of their part move into
it, the first stays (and is kept in the part as a source).  At the end each suffix stands in the
interval of its longest common prefix with any earlier suffix, whose first member is its source.
A run is maximal if it doesn't end with the run one line before.

A later copy of a maximal run of at least ``MIN_LINES`` lines and ``MIN_CHARS`` characters in all
is deleted: a long line by itself, or short lines one after another; a lone short line stays.

A step is a join on the place and an aggregation by pairs of names with partial aggregation on
the map side, joined back; no window holds an interval, so a line that occurs in millions of
documents doesn't meet in one task.

Lines are compared without white space at their ends.  Blank lines aren't part of the
sequence and stay.  Defined cases: null ids take no part and stay as they are; null and empty
texts have no lines; identical rows (same id, same text) count once and are treated alike;
different texts under one id are different texts, in the order of a hash; columns that have the
names of the count and the runs are replaced by them, all others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernel
from .kernel import U64

MIN_LINES, MIN_CHARS = 1, 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 11, 12, 13, 32]] = True


def packed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, size, payload): the lines of each text that aren't blank, as arrays: id, number among all lines, characters.

    A row that a task has had before is left out, so that a row repeated any number of times comes once from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for b in batches:
            for first, rows, col in kernel.text_slices(b, "text"):
                buf, off = kernel.raw(col)
                n = len(buf)
                if not n:
                    continue
                breaks = buf == 10
                mark = ~(_SPACE[buf] | breaks)
                solid = np.flatnonzero(mark)
                if not len(solid):
                    continue
                # lines end at breaks and where texts end
                cuts = np.union1d(np.flatnonzero(breaks) + 1, off)
                line = np.searchsorted(cuts, solid, side="right") - 1
                at, size = kernel.runs(line)
                start, end = solid[at], solid[at + size - 1] + 1
                sums = np.empty(n + 1, U64)
                sums[0] = 0
                np.cumsum((buf.astype(U64) + U64(1)) * kernel.powers(kernel.BASE, n), out=sums[1:])
                h = kernel.mix((sums[end] - sums[start]) * kernel.powers(kernel.BASE_INV, n + 1)[start]) + (end - start).astype(U64)
                doc = np.searchsorted(off, start, side="right") - 1
                head = np.concatenate([[0], np.cumsum(breaks)])
                count = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                number, chars = (head[start] - head[off[doc]]).astype(np.int32), (count[end] - count[start]).astype(np.int32)
                ids, uids = b.column(0).slice(first, rows).to_pylist(), b.column(1).slice(first, rows).to_pylist()
                begin, many = kernel.runs(doc)
                new = [(a, k, d) for a, k, d in zip(begin.tolist(), many.tolist(), doc[begin].tolist()) if not (uids[d] in had or had.add(uids[d]))]
                yield common.batch(
                    doc_id=pa.array([ids[d] for _, _, d in new], pa.int64()), uid=pa.array([uids[d] for _, _, d in new], pa.int64()), size=pa.array([k for _, k, _ in new], pa.int64()),
                    payload=pa.array([kernel.pack(h[a : a + k].view(np.int64), number[a : a + k], chars[a : a + k]) for a, k, _ in new], pa.binary()),
                )

    return docs.select("doc_id", "uid", "text").mapInArrow(common.lean(run), "doc_id bigint, uid bigint, size bigint, payload binary")


def bases(packed: DataFrame) -> DataFrame:
    """(uid, base, again): where the lines of each text begin in the corpus, by doc_id, then text (its hash); again: several rows have it."""
    texts = packed.groupBy("doc_id", "uid").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
    placed = texts.repartitionByRange(common.partitions(packed), "doc_id", "uid").withColumn("part", F.spark_partition_id()).checkpoint()
    known, total = {}, 0  # by partition of the checkpoint, which stays as it is when a task runs again
    for r in sorted(placed.groupBy("part").agg(F.sum("size").alias("all")).collect()):
        known[r["part"]] = total
        total += r["all"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if b.num_rows:
                at = known[b.column(0)[0].as_py()] if at is None else at
                size = b.column(2).to_numpy(zero_copy_only=False)
                yield common.batch(uid=b.column(1), base=at + np.cumsum(size) - size, again=pa.array(b.column(3).to_numpy(zero_copy_only=False) > 1))
                at += int(size.sum())

    ordered = placed.sortWithinPartitions("doc_id", "uid").select("part", "uid", "size", "rows")
    return ordered.mapInArrow(common.lean(run), "uid bigint, base bigint, again boolean").checkpoint()


def lines(packed: DataFrame) -> DataFrame:
    """(n, left, pos, id, uid, doc_id) of each line: n is its place in the corpus, left the number of lines from here to the text's end."""
    side = common.sized(bases(packed).toDF("__uid", "base", "again"))
    placed = packed.join(side, F.col("uid") == F.col("__uid")).select("doc_id", "uid", "base", "again", "payload")
    once = placed.where("not again").drop("again").unionByName(placed.where("again").drop("again").dropDuplicates(["uid"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [kernel.unpack(x)[0] for x in b.column(3).to_pylist()]
            if not ids:
                continue
            many = np.array([len(x) for x in ids])
            pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            doc = pa.array(np.repeat(np.arange(len(ids)), many))
            base = np.repeat(b.column(2).to_numpy(zero_copy_only=False), many)
            yield common.batch(n=base + pos, left=(np.repeat(many, many) - pos).astype(np.int32), pos=pos.astype(np.int32), id=np.concatenate(ids), uid=b.column(1).take(doc), doc_id=b.column(0).take(doc))

    return once.mapInArrow(common.lean(run), "n bigint, left int, pos int, id bigint, uid bigint, doc_id bigint")


LATER = "n <> name"


def double(now: DataFrame, step: int) -> DataFrame:
    """(n, left, name) for twice as many lines; only suffixes that still tie."""
    ahead = now.select((F.col("n") - step).alias("n"), F.col("name").alias("next"))
    both = now.where(F.col("left") > step).join(ahead, "n")  # no suffix ahead: it ties with nothing
    pairs = both.groupBy("name", "next").agg(F.count("*").alias("k"), F.min("n").alias("first")).where("k > 1").drop("k")
    return both.join(pairs, ["name", "next"]).select("n", "left", F.col("first").alias("name"))


def branching(level: DataFrame, above: DataFrame | None, h: int) -> DataFrame:
    """(n, left, src, l, need): the members of h-intervals that aren't later copies of 2h lines, where there are several; need: later copies of h lines."""
    own = level if above is None else level.join(above.where(LATER).select("n"), "n", "left_anti")
    if h == 1:  # no step is left to take
        own = own.where(LATER)
    else:
        own = own.join(own.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"), "name", "left_semi")
    return own.select("n", "left", F.col("name").alias("src"), F.lit(h).alias("l"), F.expr(LATER).alias("need"))


def descend(state: DataFrame, level: DataFrame, h: int) -> DataFrame:
    """One step: members of an interval part by the name of the h lines that follow."""
    ahead = level.select(F.col("n").alias("at"), F.col("name").alias("next"))
    at = F.when(F.col("left") > F.col("l"), F.col("n") + F.col("l"))
    met = state.withColumn("at", at).join(ahead, "at", "left").drop("at")
    group = ["src", "l", "next"]
    parts = met.where("next is not null").groupBy(*group).agg(F.count("*").alias("k"), F.min("n").alias("name"), F.max("need").alias("any")).where("k > 1 and any").select(*group, "name")
    placed = met.join(parts, group, "left")
    stay = F.struct(F.col("src").alias("src"), F.col("l").alias("l"), F.col("need").alias("need"))
    move = lambda need: F.struct(F.col("name").alias("src"), (F.col("l") + h).alias("l"), need.alias("need"))
    to = F.when(F.col("name").isNull(), F.array(stay)).when(F.expr(LATER), F.array(move(F.col("need")))).otherwise(F.array(stay, move(F.lit(False))))
    return placed.select("n", "left", F.explode(to).alias("to")).select("n", "left", "to.src", "to.l", "to.need")


def longest(level: DataFrame) -> DataFrame:
    """(n, n_lines, src) of every suffix that begins with a later copy: its longest, and its source.  level: the intervals of single lines."""
    levels = [level]
    while not level.isEmpty():
        level = double(level, 1 << (len(levels) - 1)).checkpoint()
        levels.append(level)
    state = None
    for i in reversed(range(len(levels) - 1)):
        own = branching(levels[i], levels[i + 1] if i + 2 < len(levels) else None, 1 << i)
        state = own if state is None else descend(state, levels[i], 1 << i).unionByName(own)
        state = state.checkpoint()
    state = branching(level, None, 1) if state is None else state
    return state.where("need").select("n", F.col("l").alias("n_lines"), "src")


def runs(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, pos, n_lines, source_doc_id): the maximal runs that are later copies; and a table to discard when they have been read."""
    all_lines = common.stored(lines(packed))
    # not a count: it is two places that make a tie
    first = all_lines.groupBy("id").agg(F.min("n").alias("name"), F.max("n").alias("last")).where("name < last").select("id", "name")
    tied = all_lines.select("n", "left", "id").join(first, "id").select("n", "left", "name").checkpoint()
    found = longest(tied).withColumn("end", F.col("n") + F.col("n_lines"))
    inside = found.select((F.col("n") + 1).alias("n"), "end")  # what ends with the run one line before
    maximal = found.join(inside, ["n", "end"], "left_anti")
    asked = common.sized(maximal.select("n", F.col("n").alias("at")).union(maximal.select("n", "src")).checkpoint())
    where = asked.join(all_lines.select(F.col("n").alias("at"), "uid", "pos", "doc_id"), "at")
    of = lambda c, own: F.max(F.when((F.col("at") == F.col("n")) == own, F.col(c)))
    places = where.groupBy("n").agg(of("uid", F.lit(True)).alias("uid"), of("pos", F.lit(True)).alias("pos"), of("doc_id", F.lit(False)).alias("source_doc_id"))
    return maximal.select("n", "n_lines").join(places, "n").select("uid", "pos", "n_lines", "source_doc_id"), all_lines


SIDE = "uid bigint, gone array<boolean>, n bigint, starts array<bigint>, lengths array<bigint>, sources array<bigint>"


def copies(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(uid, gone, n, starts, lengths, sources) of the texts that lose lines: whether each line up to the last deleted one is, their number, and the runs.

    docs: (doc_id, uid, text).
    """
    if min_lines < 1:
        raise ValueError("min_lines >= 1")
    packed = common.stored(packed_lines(docs))
    each = F.array_sort(F.collect_list(F.struct("pos", "n_lines", "source_doc_id")))
    found, all_lines = runs(packed)
    side = common.sized(found.groupBy(F.col("uid").alias("__uid")).agg(each.alias("runs")).checkpoint())
    common.discard(all_lines)
    met = packed.select("uid", "payload").join(side, F.col("uid") == F.col("__uid")).select("uid", "payload", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            had: set[int] = set()
            for uid, payload, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if uid in had:
                    continue
                had.add(uid)
                _, number, chars = kernel.unpack(payload)
                total = np.concatenate([[0], np.cumsum(chars)])
                kept = [(r["pos"], r["n_lines"], r["source_doc_id"]) for r in found if r["n_lines"] >= min_lines and total[r["pos"] + r["n_lines"]] - total[r["pos"]] >= min_chars]
                if not kept:
                    continue
                lost = np.unique(np.concatenate([number[p : p + k] for p, k, _ in kept]))
                mask = np.zeros(int(lost[-1]) + 1, bool)
                mask[lost] = True
                for column, value in zip(out, (uid, mask.tolist(), len(lost), [int(number[p]) for p, _, _ in kept], [k for _, k, _ in kept], [d for _, _, d in kept])):
                    column.append(value)
            numbers_ = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.list_(pa.bool_()), pa.int64(), numbers_, numbers_, numbers_)
            yield common.batch(**{n: pa.array(c, t) for n, c, t in zip(("uid", "gone", "n", "starts", "lengths", "sources"), out, kinds)})

    out = met.mapInArrow(common.lean(run), SIDE).dropDuplicates(["uid"]).checkpoint()
    common.discard(packed)
    return out


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text", removed: str = "n_removed", min_chars: int = MIN_CHARS, with_runs: bool = False) -> DataFrame:
    """All rows and columns of docs, later copies of runs cut out of the text, and the number of removed lines in a column named ``removed``.

    with_runs: also run_starts (line numbers from 0), run_lengths (lines that aren't blank) and run_sources (doc_id of the first copy)
    of the maximal runs that were cut.
    """
    common.prepare(docs.sparkSession)
    names = ["run_starts", "run_lengths", "run_sources"] if with_runs else []
    columns = [c for c in docs.columns if c != removed and c not in names]
    slim = common.reduced_scan(docs, doc_id=doc_id, text=text).where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    side = copies(slim.withColumn("uid", F.xxhash64("doc_id", "text")), min_lines, min_chars)
    own, gone, n, *lists = [common.fresh(docs, f"__{c}") for c in side.columns]
    side = side.toDF(own, gone, n, *lists).select(own, gone, n, *lists[: len(names)])
    key, source = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    uid, empty = F.xxhash64(key.cast("bigint"), source), F.array().cast("array<bigint>")

    def cut(part: DataFrame, side: DataFrame) -> DataFrame:
        joined = part.join(side, (uid == F.col(own)) & key.isNotNull(), "left")
        kept = F.filter(F.split(source, "\n", -1), lambda x, i: ~F.coalesce(F.get(F.col(gone), i), F.lit(False)))
        new = F.when(F.col(gone).isNull(), source).otherwise(F.array_join(kept, "\n"))
        more = [F.coalesce(F.col(c), empty).alias(name) for c, name in zip(lists, names)]
        return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in columns], F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(removed), *more)

    mark = common.fresh(docs, "__mark")
    ids = side.select(F.col(own).alias(mark))
    if not common.few(ids):
        return cut(docs, side)
    # only texts that lose lines are shuffled
    rest = docs.join(F.broadcast(ids), (uid == F.col(mark)) & key.isNotNull(), "left_anti")
    as_is = rest.select(*[f"`{c}`" for c in columns], F.lit(0).cast("bigint").alias(removed), *[empty.alias(c) for c in names])
    return as_is.unionAll(cut(docs.where(key.isNotNull()).join(F.broadcast(ids), uid == F.col(mark), "left_semi"), side))


#: Runs grow by one line at a time here: a group is all suffixes that begin with the same h lines, named by its first.
ORACLE_SQL = rf"""
with recursive line as (
  select doc_id, i, l, trim(l, e' \t\r\v\f') as t from (
    select doc_id, unnest(range(0, len(a))) as i, unnest(a) as l from (select doc_id, string_split(text, chr(10)) as a from documents)
  )
), seq as (
  select *, row_number() over (order by doc_id, pos) as s from (
    select doc_id, i, t, length(t) as n, row_number() over (partition by doc_id order by i) as pos from line where t <> ''
  )
), grown as (
  select * from (select 1 as h, doc_id, pos, s, min(s) over (partition by t) as g, count(*) over (partition by t) as k from seq) where k > 1
  union all
  select * from (
    select r.h + 1 as h, r.doc_id, r.pos, r.s, min(r.s) over (partition by r.g, x.t) as g, count(*) over (partition by r.g, x.t) as k
    from grown r join seq x on x.doc_id = r.doc_id and x.pos = r.pos + r.h
  ) where k > 1
), longest as (
  select doc_id, pos, s, max(h) as n_lines, arg_max(g, h) as g from grown where g <> s group by doc_id, pos, s
), maximal as (
  select * from (select *, coalesce(lag(pos) over o = pos - 1 and lag(pos + n_lines) over o = pos + n_lines, false) as inside from longest window o as (partition by doc_id order by pos)) where not inside
), run as (
  select m.doc_id, m.pos, m.n_lines, min(x.i) as start, any_value(src.doc_id) as source
  from maximal m join seq x on x.doc_id = m.doc_id and x.pos between m.pos and m.pos + m.n_lines - 1 join seq src on src.s = m.g
  group by m.doc_id, m.pos, m.n_lines having sum(x.n) >= {MIN_CHARS} and m.n_lines >= {MIN_LINES}
), gone as (
  select distinct x.doc_id, x.i from run r join seq x on x.doc_id = r.doc_id and x.pos between r.pos and r.pos + r.n_lines - 1
), kept as (
  select l.doc_id, string_agg(case when g.i is null then l.l end, chr(10) order by l.i) as text, count(g.i) as n_removed
  from line l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
), cut as (
  select doc_id, list(start order by start) as run_starts, list(cast(n_lines as bigint) order by start) as run_lengths, list(source order by start) as run_sources from run group by doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(k.n_removed, 0) as n_removed,
       coalesce(run_starts, []) as run_starts, coalesce(run_lengths, []) as run_lengths, coalesce(run_sources, []) as run_sources
from documents d left join kept k on d.doc_id = k.doc_id left join cut c on d.doc_id = c.doc_id
"""

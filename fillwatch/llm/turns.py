"""Operator 12: repair of conversations by alignment with every feasible length of the alternating roles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwatch.llm.common import CRC_SQL, crc_sql, materialise, sized

#: What edits cost; an undeleted truncated turn costs as much as an inserted one besides.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turn codes: role initials (o: none of the grammar's), capitals where truncated, d where the turn must go.
MUST_GO = "d"
_INF = np.int64(1 << 40)


class Table:
    """Wagner-Fischer table of the costs to align the turns from i on with the last e letters of the grammar's string.

    The letters that are left tell the next one (an even number: user), so all lengths of the string share one table.
    Ukkonen's band: only cells that lie at most `up` inserts and `down` deletions off the diagonal, that is off the number
    of turns left that needn't go. Every sqrt(n)-th row is kept, the others are computed again while an audit is read back.
    """

    def __init__(self, codes: str, down: int, up: int):
        self.codes, self.down, self.n = codes, down, len(codes)
        self.live = np.r_[np.cumsum(np.array([c != MUST_GO for c in reversed(codes)], np.int64))[::-1], 0]
        self.offsets = np.arange(-down, up + 1)
        self.step = max(16, math.isqrt(self.n) + 1)
        self.stops: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}

    def rows(self, below: np.ndarray | None, i: int, to: int) -> Iterator[tuple[int, np.ndarray]]:
        """Rows i, i - 1, .. to, below being row i + 1."""
        for k in range(i, to - 1, -1):
            left = self.offsets + self.live[k]
            if k == self.n:
                row = np.where(left >= 0, INSERT * left, _INF)
            elif self.codes[k] == MUST_GO:
                row = below + DELETE
            else:
                code = self.codes[k]
                fits = code.lower() == np.where(left % 2 == 0, "u", "a")
                row = np.where(left > 0, below + np.where(fits, 0, REROLE) + TRUNCATED * code.isupper(), _INF)
                row[:-1] = np.minimum(row[:-1], below[1:] + DELETE)
                row = np.where(left >= 0, row, _INF)
            slope = INSERT * self.offsets
            row = np.minimum.accumulate(row - slope) + slope
            below = np.where(left >= 0, np.minimum(row, _INF), _INF)
            yield k, below

    def fill(self) -> Iterator[tuple[int, np.ndarray]]:
        for k, row in self.rows(None, self.n, 0):
            if k % self.step == 0 or k == self.n:
                self.stops[k] = row
            yield k, row

    def at(self, i: int, e: int) -> int:
        if i not in self.block:
            stop = min(self.n, (i // self.step + 1) * self.step)
            start = i // self.step * self.step
            self.block = {stop: self.stops[stop]} | dict(self.rows(self.stops[stop], stop - 1, start)) | {k: v for k, v in self.block.items() if k == start}
        x = e - self.live[i] + self.down
        return int(self.block[i][x]) if e >= 0 and 0 <= x < len(self.offsets) else int(_INF)

    def audit(self, i: int, e: int) -> str:
        """The cheapest edits from a cell on, of equal ones the least in ASCII's order."""
        out = []
        while i < self.n or e:
            cost, code = self.at(i, e), self.codes[i] if i < self.n else ""
            extra = TRUNCATED * code.isupper()
            if code and self.at(i + 1, e) + DELETE == cost:
                out.append("D")
            elif self.at(i, e - 1) + INSERT == cost:
                out.append("I")
                e -= 1
                continue
            elif code.lower() == "ua"[e % 2] and self.at(i + 1, e - 1) + extra == cost:
                out.append("K")
                e -= 1
            else:
                out.append("R")
                e -= 1
            i += 1
        return "".join(out)


def _best(codes: str, down: int, up: int) -> tuple[int, list[tuple[int, int]], Table]:
    """Least cost in a band, and where the alignments begin that have it: (turns before, all deleted; letters left).

    Without a system turn they begin at turn 0; with one, behind a kept system turn with all before it deleted.
    """
    table, best, starts = Table(codes, down, up), int(_INF), []
    for k, row in table.fill():
        begins = [(0, 0, 0)] if k == 0 else []
        if k and codes[k - 1] in "sS":
            begins.append((k, DELETE * (k - 1) + TRUNCATED * codes[k - 1].isupper(), 2))
        for i, before, least in begins:
            left = table.offsets + table.live[k]
            costs = np.where((left % 2 == 0) & (left >= least), row + before, _INF)
            low = int(costs.min())
            if low < best:
                best, starts = low, []
            if low == best < _INF:
                starts += [(i, int(e)) for e in left[costs == low]]
    return best, starts, table


def align(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation, given as turn codes.

    A narrow band gives an incumbent. Every repair pays for the turns that must go and the truncated ones; what the
    incumbent pays over that bounds how far a cheaper or equally cheap one can leave the diagonal, so the second band
    misses none. The audits of all lengths with the least cost are compared.
    """
    sure = sum(DELETE if c == MUST_GO else TRUNCATED * c.isupper() for c in codes)
    loss = DELETE - TRUNCATED if any(c.isupper() for c in codes) else DELETE
    cost, starts, table = _best(codes, 2, 2)
    down, up = (cost - sure) // loss, (cost - sure) // INSERT
    if down > 2 or up > 2:
        cost, starts, table = _best(codes, max(2, down), max(2, up))
    return cost, min("D" * (i - 1) + "K" * (i > 0) + table.audit(i, e) for i, e in starts)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [align(c) for c in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["codes", "cost", "audit"])


_VISIBLE = r"[^\x20\x09-\x0D]"


def turn_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, present) with each present turn's number k, fault, code and what its conversation's counts need."""
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy(F.col("present").desc(), F.col("turn").asc_nulls_first(), "role", "text", "nth")
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(~F.col("text").rlike(_VISIBLE), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(F.when(F.col("fault") == "truncated", F.upper("letter")).otherwise(F.col("letter")))
    # one exchange serves both windows
    x = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    x = x.withColumns({"k": F.row_number().over(order), "before": F.lag(initial).over(order), "earlier": F.lag("turn").over(order), "fault": fault, "letter": F.when(initial.isin("s", "u", "a"), initial).otherwise("o")})
    x = x.withColumns({"code": code, "illegal": F.coalesce(~F.concat("before", initial).isin("su", "ua", "au"), F.lit(False)), "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earlier"))})
    return x.select("conv_id", "present", "k", "turn", "role", "text", "fault", "code", "illegal", "new_turn")


def summarise(turns: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, and its turn codes in order."""
    here = F.col("present")
    number = lambda c: F.coalesce(F.sum(F.when(here & c, 1)), F.lit(0))
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(here, F.struct("k", "code")))), lambda x: x["code"]), "")
    last, first = F.max(F.when(here, F.col("turn"))), F.min(F.when(here, F.col("turn")))
    return turns.groupBy("conv_id").agg(
        F.coalesce(last - first + 1 - number(F.col("new_turn")), F.lit(0)).alias("gaps"), *(number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        number(F.col("illegal")).alias("illegal"), codes.alias("codes"),
    )


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns in order, from rows in the order of (conv_id, k): first a conversation's audit, as text of row 0, then its turns."""
    audit, at, place, odd = "", 0, 0, 0
    out: list[tuple] = []

    def put() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "place", "edit", "role", "text"])

    def due(place: int) -> str:
        return ("assistant", "user")[(place - odd) % 2 == 0]

    for batch in batches:
        for conv, k, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k == 0:
                audit, at, place = text, 0, 0
                odd = (len(audit) - audit.count("D")) % 2  # a system turn leads
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    out.append((conv, place, edit, due(place) if edit == "R" else role, text))
                    place += 1
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", due(place), ""))
                at, place = at + 1, place + 1
            if len(out) >= 4096:
                yield put()
                out = []
    if out:
        yield put()


def repair(rows: DataFrame, present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): of rows (conv_id, turn, role, text) each conversation's counts, cost and audit, and its repaired
    turns (conv_id, place, edit, role, text), those of a conversation in one partition and in order.

    Rows that aren't `present` only name their conversation. Turns stand by number, nulls first, ties by role and text;
    null roles and texts are one space; a null conversation id is one conversation; repeated rows are duplicates; other
    columns are ignored; an empty table gives empty results. Conversations with equal turn codes are aligned once. A
    conversation's codes and audit (a character a turn) are held in one task, its texts are only streamed through it: a
    conversation's repair is one sequence, so a very long one takes one task's time, not its memory.
    """
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.lit(True) if present is None else present).alias("present"),
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = materialise(turn_faults(rows), "turns")
    each = materialise(summarise(turns), "conversations")
    audits = materialise(each.select("codes").distinct().repartition(n, "codes").mapInArrow(_align, "codes string, cost long, audit string"), "audits")
    each = materialise(each.join(sized(audits, 1 << 26, F.length("codes") + F.length("audit") + 64), "codes").drop("codes"), "audited")
    lead = each.select("conv_id", F.lit(0).alias("k"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = lead.union(turns.where("present").select("conv_id", "k", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "k")
    return each, stream.mapInArrow(_edit, "conv_id long, place long, edit string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each conversation's repaired turns, which come in order."""
    now, h = None, None

    def put() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        done = []
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if h:
                    done.append((now, h.hexdigest()))
                now, h = conv, hashlib.sha256()
            h.update((f"{role}:{text}" if place == 0 else f"\n{role}:{text}").encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done])], names=["conv_id", "repaired_sha256"])
    if h:
        yield put()


def damaged(chats: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of `conv_id:turn`; nulls are one space. Dropped rows stay, not present."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = chats.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("act"))
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("act") != 0).alias("present"), F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"))
    return x.select("conv_id", "turn", "role", "text", "present", F.explode("times").alias("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    each, turns = repair(rows, F.col("present"))
    digests = materialise(turns.mapInArrow(_digest, "conv_id long, repaired_sha256 string"), "digests").withColumnRenamed("conv_id", "id")
    out = each.hint("merge").join(digests, each.conv_id.eqNullSafe(digests.id), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The repair as a walk through the grammar's states (0 start, 1 behind a system turn, 2 assistant due, 3 user due), keeping the
#: least (cost, audit) of each: audits that end in one state at one turn can be compared before they go on.
ORACLE = rf"""
WITH RECURSIVE {CRC_SQL}
 c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS act FROM conversations, crc_),
 c1 AS (SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c0, unnest(range(CASE act WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(copy)),
 c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM c1),
 c3 AS (SELECT *, row_number() OVER w AS k, lag(role[1]) OVER w AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
   FROM c2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)),
 counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM c3 GROUP BY conv_id),
 inserted(st, nx, ins, price) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (1, 2, 'I', 3), (2, 3, 'I', 3), (3, 2, 'I', 3), (0, 3, 'II', 6), (1, 3, 'II', 6), (2, 2, 'II', 6), (3, 3, 'II', 6)),
 edits(st, nx, edit, needs, price) AS (VALUES (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (0, 2, 'R', '', 3), (1, 2, 'R', '', 3), (3, 2, 'R', '', 3), (2, 3, 'R', '', 3), (0, 0, 'D', '', 4), (1, 1, 'D', '', 4), (2, 2, 'D', '', 4), (3, 3, 'D', '', 4)),
 walk(conv_id, k, st, b) AS (SELECT conv_id, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': ''}} FROM counts
  UNION ALL SELECT w.conv_id, w.k + 1, e.nx, min({{'c': w.b.c + i.price + e.price + CASE WHEN x.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END, 'a': w.b.a || i.ins || e.edit}})
   FROM walk AS w JOIN c3 AS x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.k = w.k + 1 JOIN inserted AS i ON i.st = w.st JOIN edits AS e ON e.st = i.nx AND (e.edit = 'D' OR x.fault NOT IN ('blank', 'duplicate') AND e.needs IN ('', x.role[1])) GROUP BY w.conv_id, w.k, e.nx),
 best AS (SELECT w.conv_id, min({{'c': w.b.c + i.price, 'a': w.b.a || i.ins}}) AS b FROM walk AS w JOIN counts ON counts.conv_id IS NOT DISTINCT FROM w.conv_id AND counts.n = w.k JOIN inserted AS i ON i.st = w.st AND i.nx IN (0, 3) GROUP BY w.conv_id),
 letters AS (SELECT conv_id, p, b.a[p] AS edit, length(replace(b.a[1:p], 'I', '')) AS k, length(replace(b.a[1:p], 'D', '')) - 1 AS place, length(replace(b.a, 'D', '')) % 2 AS odd FROM best, unnest(range(1, length(b.a) + 1)) AS r(p)),
 repaired AS (SELECT l.conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || (CASE edit WHEN 'I' THEN '' ELSE text END), chr(10) ORDER BY p) AS t
   FROM letters AS l LEFT JOIN c3 ON c3.conv_id IS NOT DISTINCT FROM l.conv_id AND c3.k = l.k WHERE edit <> 'D' GROUP BY l.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM o.conv_id
"""

"""Repair of conversation structure by weighted CYK interval parsing.

The wanted order of role initials is ``(s?(ua)+)?``. Its grammar in Chomsky normal form has one nonterminal per pair of states of
that order, before and after a span, and the binary rules (p, q) -> (p, r) (r, q). A span's table holds for each nonterminal the
cell (cost, audit) of its cheapest derivation from the span's rows; rows are terminals that may be kept, changed or deleted, and
every terminal's cells are closed under insertion on both sides. Tables of spans are combined bottom-up by span length.

Why one split of each span is enough: a derivation of a span passes some state at every place within it, so any split gives the
same cells. And why the least of two cells can be taken at once: among the audits of one span, cost follows from the letters, so
of two audits of equal cost none is the beginning of the other, and joining keeps their order.

Any split will do, so a conversation of any length is parsed in parallel: rows are sorted by range, each range parses its part of
a conversation, and the tables of the parts are combined.
"""

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moneytrail.functions.skew import salted_join
from moneytrail.llm.helpers import WORD
from moneytrail.scratch import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: States: nothing yet; after the system turn; after a user turn, owing an answer; after an answer.
START, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ANSWERED, "u"): ASKED, (ASKED, "a"): ANSWERED}
STATES, ENDS = range(4), (START, ANSWERED)
LEGAL = ("su", "ua", "au")
#: Characters of a text by which rows of one turn and role are ordered before their hashes are.
LEAD = 64
CELLS = [(p, q) for p in STATES for q in STATES]

Cell = tuple[int, str]
Table = dict[tuple[int, int], Cell]


def combine(left: Table, right: Table) -> Table:
    """The table of two adjacent spans together: the least cell over the state between them."""
    out: Table = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            after = right.get((r, q))
            if after is None:
                continue
            total, best = cost + after[0], out.get((p, q))
            if best is None or total < best[0] or total == best[0] and audit + after[1] < best[1]:
                out[p, q] = total, audit + after[1]
    return out


def least(*tables: Table) -> Table:
    out: Table = {}
    for pair, cell in chain.from_iterable(t.items() for t in tables):
        if pair not in out or cell < out[pair]:
            out[pair] = cell
    return out


def insertions() -> Table:
    """The empty span with as many turns inserted as take one state to another."""
    none = {(p, p): (0, "") for p in STATES}
    one = least(none, {(p, q): (INSERT_COST, INSERT) for (p, role), q in STEPS.items() if role != "s"})
    closed = none
    for _ in STATES:
        closed = least(closed, combine(closed, one))
    return closed


NOTHING = insertions()


def leaf(initial: str, removed: bool, truncated: bool) -> Table:
    """The table of one row. A row that must go is deleted; another costs more, if kept or changed, when it is truncated."""
    table = {(p, p): (DELETE_COST, DELETE) for p in STATES}
    if not removed:
        more = TRUNCATED_COST if truncated else 0
        for (p, role), q in STEPS.items():
            edits = [(more, KEEP)] if role == initial else [(REROLE_COST + more, REROLE)] if role != "s" else []
            for edit in edits:
                table[p, q] = min(table.get((p, q), edit), edit)
    return combine(combine(NOTHING, table), NOTHING)


LEAVES = {(i, removed, truncated): leaf(i, removed, truncated) for i in "sua-" for removed in (False, True) for truncated in (False, True)}


def parse(tables: Iterable[Table]) -> Table:
    """The table of all adjacent spans together. Spans of equal length are combined first, so lengths double."""
    waiting: list[tuple[int, Table]] = []
    for table in tables:
        length = 1
        while waiting and waiting[-1][0] == length:
            table = combine(waiting.pop()[1], table)
            length *= 2
        waiting.append((length, table))
    table = NOTHING
    while waiting:
        table = combine(waiting.pop()[1], table)
    return table


def cheapest(table: Table) -> Cell:
    """The cell of the whole conversation: from the start to an end."""
    return min(table[START, end] for end in ENDS if (START, end) in table)


def edits(audit: str) -> Iterator[tuple[str, str]]:
    """Letters of an audit, each with the run of insertions before it; the last has none or the insertions at the end."""
    at = 0
    while at < len(audit):
        inserted = at
        while at < len(audit) and audit[at] == INSERT:
            at += 1
        yield audit[inserted:at], audit[at:at + 1]
        at += 1


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Turns (edit, role, text) of a conversation whose ``rows`` (role, text) are edited as the audit says."""
    rows, state = iter(rows), START

    def turn(edit, role, text):
        nonlocal state
        state = STEPS[state, role[0]]
        return edit, role, text

    def due():
        return "assistant" if state == ASKED else "user"

    for inserted, letter in edits(audit):
        for _ in inserted:
            yield turn(INSERT, due(), "")
        if letter:
            role, text = next(rows)
            if letter != DELETE:
                yield turn(letter, role if letter == KEEP else due(), text)


def conversations_of(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal ``key``, the first columns of sorted batches; each run must be read before the next is asked for."""
    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    flow, n = rows(), len(key)
    ahead = next(flow, None)

    def run(of):
        nonlocal ahead
        while ahead is not None and ahead[:n] == of:
            row, ahead = ahead, next(flow, None)
            yield row[n:]

    while ahead is not None:
        of = ahead[:n]
        current = run(of)
        yield of, current
        for _ in current:
            pass


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield _batch(waiting, schema)
            waiting = []
    if waiting:
        yield _batch(waiting, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def ordered() -> list[Column]:
    """The order of a conversation's rows. Whole texts are no sort keys: after their start a hash of them decides."""
    return [F.col(c).asc_nulls_first() for c in ("turn", "role", "lead", "code", "copy")]


def faults(turns: DataFrame) -> DataFrame:
    """All rows with ``lead`` and ``code``, start and hash of the text, ``copy``, their number among equal rows, and ``fault``.

    Fault is the first of blank, duplicate, truncated, or null. Equal rows are counted before they are shuffled. Of the rows with
    one role and text the first in order is no duplicate.
    """
    code = F.sha2("text", 256)
    known = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    counted = materialize(
        turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
        .withColumns({"lead": F.left("text", F.lit(LEAD)), "code": code})
        .withColumn("said", F.sha2(F.concat_ws(":", F.length(known).cast("string"), known, "code", "role"), 256)),
        "turns",
    )
    # a struct orders a null turn first
    first = counted.groupBy("said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").select("said", "first")
    rows = salted_join(counted, first, "said", F.col("turn"), "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    )
    seen = (F.col("copy") > 1) | (F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first")))
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank").when(seen, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*+\z"), "truncated")
    )
    return rows.select("conv_id", "turn", "role", "lead", "code", "copy", "text", fault.alias("fault"))


def parsed(rows: DataFrame, parts: int) -> DataFrame:
    """conv_id, cost, audit and illegal (adjacent role initials that don't follow each other) of every conversation with rows."""
    spark = rows.sparkSession
    initial = F.substring("role", 1, 1)
    light = rows.select(
        "conv_id", "turn", "role", "lead", "code", "copy", initial.alias("initial"),
        F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("removed"),
        F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"),
    )
    key = rows.schema["conv_id"]
    cells = [T.StructField(f"{k}{p}{q}", t) for p, q in CELLS for k, t in (("c", T.LongType()), ("a", T.StringType()))]
    sides = [T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("illegal", T.LongType())]
    part_schema = T.StructType([key, T.StructField("part", T.IntegerType()), *sides, *cells])

    def flat(table: Table) -> list:
        return list(chain.from_iterable(table.get(pair, (None, None)) for pair in CELLS))

    def of_rows(batches):
        def each():
            for of, run in conversations_of(batches, ["conv_id", "part"]):
                first = last = None
                illegal = 0

                def tables():
                    nonlocal first, last, illegal
                    for initial, removed, truncated in run:
                        if first is None:
                            first = initial
                        else:
                            illegal += last + initial not in LEGAL
                        last = initial
                        yield LEAVES[initial if initial in ("s", "u", "a") else "-", removed, truncated]

                table = parse(tables())
                yield (*of, first, last, illegal, *flat(table))
        return in_batches(each(), to_arrow_schema(part_schema))

    whole = [T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("illegal", T.LongType())]

    def of_parts(batches):
        def each():
            for of, run in conversations_of(batches, ["conv_id"]):
                last, illegal = None, 0

                def tables():
                    nonlocal last, illegal
                    for _, first, end, within, *flat_cells in run:
                        illegal += within + (last is not None and last + first not in LEGAL)
                        last = end
                        yield {pair: (c, a) for pair, c, a in zip(CELLS, flat_cells[::2], flat_cells[1::2]) if c is not None}

                yield (*of, *cheapest(parse(tables())), illegal)
        return in_batches(each(), to_arrow_schema(T.StructType([key, *whole])))

    order = [F.col("conv_id"), *ordered()]
    ranges = light.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    by_part = materialize(
        ranges.select("conv_id", "part", "initial", "removed", "truncated").mapInArrow(of_rows, part_schema), "parsed-parts"
    )
    gathered = by_part.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return materialize(gathered.mapInArrow(of_parts, T.StructType([key, *whole])), "parsed")


class Repair:
    """A repaired table of conversations.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Rows of a conversation go by turn, null first, then by
    role, the start of the text and its hash. A null role or text is one space, a null conv_id a conversation of its own. An empty role has no initial, so
    such a turn is never kept as it is. Repeated rows are rows of their own, duplicates of the first. A row's first fault counts:
    ``blank`` (nothing but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (no ``.``, ``!`` or ``?`` at
    the end). Blank and duplicate rows are deleted. An empty table gives empty results. Very long texts take part whole.
    """

    def __init__(self, turns: DataFrame):
        space = F.lit(" ")
        self.given = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
        self.rows = materialize(faults(self.given), "faults")
        self.parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.parsed = parsed(self.rows, self.parts)

    def summary(self) -> DataFrame:
        """One row per conversation: conv_id, gaps (turn numbers missing), blank, duplicate, truncated, illegal, cost, audit."""
        faulty = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
        counts = self.rows.groupBy("conv_id").agg(gaps.alias("gaps"), *faulty)
        found = self.parsed.withColumnRenamed("conv_id", "of")
        return counts.join(found, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def _edited(self, make, fields: list[T.StructField]) -> DataFrame:
        """``make(audit, rows)`` for every conversation, whose rows follow its audit in one sorted stream and are never gathered."""
        key = self.rows.schema["conv_id"]
        heads = self.parsed.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"))
        stream = self.rows.drop("fault").withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)

        def edit(batches):
            def each():
                for of, run in conversations_of(batches, ["conv_id"]):
                    audit = next(run)[1]
                    for made in make(audit, run):
                        yield (*of, *made)
            return in_batches(each(), to_arrow_schema(T.StructType([key, *fields])))

        inside = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ordered())
        return inside.select("conv_id", "role", "text").mapInArrow(edit, T.StructType([key, *fields]))

    def turns(self) -> DataFrame:
        """The repaired conversations as rows: conv_id, place (from 0), edit (K, R or I), role, text."""
        fields = [("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]

        def make(audit, rows):
            return ((n, *made) for n, made in enumerate(repaired(audit, rows)))

        return self._edited(make, [T.StructField(n, t) for n, t in fields])

    def digests(self) -> DataFrame:
        """conv_id and sha256, lowercase hex, of the repaired ``role:text`` turns, joined by line feeds.

        A digest is made in order, so one task reads a conversation, row by row.
        """
        def make(audit, rows):
            digest = sha256()
            for n, (_, role, text) in enumerate(repaired(audit, rows)):
                digest.update(f"{'' if n == 0 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield (digest.hexdigest(),)

        return self._edited(make, [T.StructField("sha256", T.StringType())])

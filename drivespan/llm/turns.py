"""Repair of conversations: faults, cheapest edits and the repaired text's digest, by conversation.

Turns become symbols (role initial and fault), conversations sequences of them. A Re-Pair grammar is learned from all sequences, in rounds that count pairs where the sequences lie;
its rules' matrices (see turn_grammar) are broadcast, a bounded number of bounded size, and each distinct sequence is evaluated once, whatever the number of conversations that have it.

Rows are dealt to ranges of conversation and turn and cut into stretches of STRETCH turns, so a conversation of any length passes through many tasks; its stretches' matrices
are then followed in order. Only the digest of the repaired text has to read a conversation's rows one after another; it streams over sorted rows and holds
one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from drivespan.llm import turn_grammar as tg
from drivespan.llm.shared import written

STRETCH = 4096
ROUNDS = 8
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: The order of a conversation's rows; rows of one turn go by role and the text's digest.
ORDER = ["conv_id", "turn", "role", "digest"]


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kept): the rows after a fault drawn by the crc32 of conv_id:turn modulo 20; dropped rows are there with kept false.

    0 drops the row, 1 empties its text, 2 takes . ! ? out of it, 3 repeats the row, 4 makes it the user's. Nulls are one space, but for a null turn's or conv_id's own value.
    """
    draw = F.pmod(F.crc32(F.concat(_filled(F.col("conv_id")), F.lit(":"), _filled(F.col("turn")))), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled(F.col("role")).alias("role"), _filled(F.col("text")).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") != 0).alias("kept"), times.alias("copy")).drop("copy")


def _looked_at(rows: DataFrame) -> DataFrame:
    """rows with the text's digest, and whether it is blank or ends as a sentence does."""
    end = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    return rows.select("conv_id", "turn", "role", "kept", "text", F.sha2("text", 256).alias("digest"), end.alias("end")).withColumns({"blank": F.col("end") == "", "ends": F.col("end").isin(".", "!", "?")}).drop("end")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, kept, n, blank, ends, first): a row for each turn, role and text, n times there; first: the text was not seen in that role in an earlier turn."""
    one = _looked_at(rows).groupBy(*ORDER, "kept").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("ends").alias("ends"))
    one = written(one, "turns")
    # null turns come first: they are told by a flag, as min() leaves nulls out
    again = one.filter("kept and not blank").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("least")).filter("turns > 1")
    again = written(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least"), "turns-again")
    met = one.join(again.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return met.select(*one.columns, (F.col("least").isNull() | F.col("turn").eqNullSafe(F.col("least.turn"))).alias("first"))


def _counts(found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation."""
    n = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("long")
    own, first = F.col("kept") & ~F.col("blank"), F.col("first")
    turn = F.when(F.col("kept"), F.col("turn"))
    turns = found.select("conv_id", turn.alias("turn")).distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    sums = found.groupBy("conv_id").agg(n(F.when(F.col("kept") & F.col("blank"), F.col("n"))).alias("blank"), n(F.when(own, F.col("n") - F.when(first, 1).otherwise(0))).alias("duplicate"), n(F.when(own & first & ~F.col("ends"), 1)).alias("truncated"))
    return turns.withColumnRenamed("conv_id", "c").join(sums, F.col("c").eqNullSafe(F.col("conv_id"))).select("conv_id", "gaps", "blank", "duplicate", "truncated")


def stretches(found: DataFrame, size: int = STRETCH) -> DataFrame:
    """(conv_id, part, no, first, last, illegal, symbols): each conversation's turns in order, cut where a task or `size` turns end; parts and then numbers give the order.

    first and last are role initials; illegal counts neighbours inside the stretch that must not follow each other.
    """
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin(*ROLES), initial).otherwise("x")
    symbol = F.when(F.col("blank") | ~F.col("first"), tg.MUST_GO).when(F.col("ends"), initial).otherwise(F.upper(initial))
    rows = found.filter("kept").select(*ORDER, initial.alias("initial"), symbol.alias("symbol"), "n")
    rows = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ORDER)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ORDER)).select("conv_id", "initial", "symbol", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, here = TaskContext.get().partitionId(), 0, None
        initials: list[str] = []
        symbols: list[str] = []
        held, out = 0, []

        def cut():
            nonlocal no, held
            if held:
                a = "".join(initials)
                out.append((here, part, no, a[0], a[-1], sum(x + y not in LEGAL for x, y in pairwise(a)), "".join(symbols)))
            initials.clear()
            symbols.clear()
            no, held = no + 1, 0

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, initial, symbol, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "symbol", "n")), strict=True):
                if conv != here:
                    cut()
                    here = conv
                while n:  # a row's copies follow it; they go
                    m = min(n, size - held)
                    initials.append(initial * m)
                    symbols.append(symbol + tg.MUST_GO * (m - 1))
                    held, n, symbol = held + m, n - m, tg.MUST_GO
                    if held == size:
                        cut()
            yield from _rows(out, kind)
            out.clear()
        if held:
            cut()
            yield from _rows(out, kind)

    def _rows(out: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        kinds = [kind, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", "part", "no", "first", "last", "illegal", "symbols"])

    schema = found.select("conv_id").withColumns({"part": F.lit(0), "no": F.lit(0).cast("long"), "first": F.lit(""), "last": F.lit(""), "illegal": F.lit(0).cast("long"), "symbols": F.lit("")}).schema
    return rows.mapInArrow(run, schema)


def learned(sequences: DataFrame, rounds: int = ROUNDS) -> tg.Grammar:
    """A grammar of the sequences (symbols, n), by Re-Pair in rounds: each counts the pairs over all of them and gives rules to the most frequent ones. No result depends on how many rules there are."""
    grammar = tg.Grammar()
    for _ in range(rounds):
        shared = sequences.sparkSession.sparkContext.broadcast(grammar)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.pairs(dict(zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pair", "n"])

        # at most (9 + MOST_RULES) ** 2 pairs; of those the best few can be chosen in a round
        top = sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(256).collect()
        more = grammar.grown([(r.pair, r.n) for r in top])
        if more.rules == grammar.rules:
            break
        grammar = more
    return grammar


def _evaluated(sequences: DataFrame, grammar: tg.Grammar) -> DataFrame:
    """(symbols, matrix) of each distinct sequence."""
    shared = sequences.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("symbols"), pa.array([tg.written(shared.value.matrix(s)) for s in batch.column("symbols").to_pylist()], pa.string())], ["symbols", "matrix"])

    return sequences.select("symbols").mapInArrow(run, "symbols string, matrix string")


def _followed(parts: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit): each conversation's stretches in order, their matrices applied to the start."""
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").select("conv_id", "first", "last", "illegal", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, live, last, illegal, any_row, out, kind = None, None, "", 0, False, [], None

        def close():
            if any_row:
                out.append((here, illegal, *tg.cheapest(live)))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, first, end, inside, matrix in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if conv != here or not any_row:
                    close()
                    here, live, last, illegal, any_row = conv, {tg.START: (0, "")}, "", 0, True
                illegal += inside + (last != "" and last + first not in LEGAL)
                live, last = tg.follow([live.get(p) for p in tg.STATES], [tg.read(matrix)]), end
            yield _repaired_rows(out, kind)
            out.clear()
        if any_row:
            close()
            yield _repaired_rows(out, kind)

    schema = parts.select("conv_id").withColumns({"illegal": F.lit(0).cast("long"), "cost": F.lit(0).cast("long"), "audit": F.lit("")}).schema
    return rows.mapInArrow(run, schema)


def _repaired_rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", "illegal", "cost", "audit"])


class _Digest:
    """Writes one conversation's repaired turns into a digest, as its rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, tg.START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any, self.state = True, tg.MOVES[self.state, role[0]]

    def _due(self) -> str:
        return ROLES["a" if self.state == tg.USER else "u"]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._say(self._due(), "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._say(role if edit == "K" else self._due(), text)

    def end(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def _digested(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """heads with repaired_sha256. rows: (conv_id, turn, role, digest, text); each conversation's head comes before its rows."""
    names = [c for c in heads.columns if c != "conv_id"]
    both = heads.select("conv_id", F.struct(*names).alias("head")).unionByName(rows.select("conv_id", "turn", "role", "digest", "text"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "role", "digest").select("conv_id", "head", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, conv, digest, kinds = None, None, None, None
        for batch in batches:
            kinds, out = (batch.schema.field("conv_id").type, batch.schema.field("head").type), []
            for c, head, role, text in zip(*(batch.column(x).to_pylist() for x in batch.schema.names), strict=True):
                if head is not None:
                    if digest is not None:
                        out.append((conv, own, digest.end()))
                    own, conv, digest = head, c, _Digest(head["audit"])
                else:
                    digest.turn(role, text)
            yield made(out, kinds)
        if digest is not None:
            yield made([(conv, own, digest.end())], kinds)

    def made(out: list[tuple], kinds: tuple) -> pa.RecordBatch:
        fields = [pa.array([own[c] for _, own, _ in out], kinds[1].field(c).type) for c in names]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in out], kinds[0]), *fields, pa.array([d for _, _, d in out], pa.string())], ["conv_id", *names, "repaired_sha256"])

    return both.mapInArrow(run, heads.select("conv_id", *names).withColumn("repaired_sha256", F.lit("")).schema)


def repair(rows: DataFrame, size: int = STRETCH, rounds: int = ROUNDS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of rows (conv_id, turn, role, text, and kept: false for rows that only name their conversation).

    Null roles and texts are one space. Rows of a null conv_id are one conversation, null turns come first, rows of one turn go by role and by the text's digest, and equal rows are duplicates of each other. An empty role cannot be kept. A conversation without
    kept rows has zeros, an empty audit and the digest of the empty string; an empty table gives an empty table. Other columns are not read.
    """
    kept = F.coalesce("kept", F.lit(True)) if "kept" in rows.columns else F.lit(True)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _filled(F.col("role")).alias("role"), _filled(F.col("text")).alias("text"), kept.alias("kept"))
    found = written(faults(own), "turns-found")
    cut = written(stretches(found, size), "turns-cut")
    sequences = written(cut.groupBy("symbols").agg(F.count("*").alias("n")), "turns-sequences")
    matrices = written(_evaluated(sequences, learned(sequences, rounds)), "turns-matrices")
    costs = _followed(cut.join(matrices.hint("merge"), "symbols")).withColumnRenamed("conv_id", "c")
    heads = _counts(found).join(costs, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    heads = heads.select("conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0).cast("long")).alias("illegal"), F.coalesce("cost", F.lit(0).cast("long")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    return _digested(_looked_at(own).filter("kept"), written(heads, "turns-heads"))

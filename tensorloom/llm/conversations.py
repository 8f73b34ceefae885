"""Repair of the order of speakers in conversations, at the least cost of edits.

The roles of a whole conversation must read ``(s?(ua)+)?`` by their initials.  The
edits form a lattice of nodes (rows read, state of the grammar); Dijkstra walks it
in the order of (cost, audit) and stops at the first end node that it takes out.

Rows are ordered once by ranges of (conversation, turn) and cut into pieces of at
most ``PIECE`` rows, so a conversation of any length is spread over tasks.  Each
piece is solved from every state in which it can be entered; the few best ways
through the pieces of a conversation are then joined.  Texts stay in the JVM until
the repaired conversation is hashed row by row, whose order no task can change.

Defined results: null values count as one space; rows without an id are one
conversation; turns come nulls first, then by role and text; a conversation without
rows after the damage has zeros, an empty audit and the hash of nothing; repeated
rows are duplicates; an empty table gives no row; other columns are ignored.  Texts
have no length limit; an audit is as long as its conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import SPACE, materialize

#: Rows of a conversation that are solved in one go.
PIECE = 256
#: Characters of a text by which rows are dealt; the order itself goes by whole texts.
DEALT_CHARS = 64

#: States of the grammar (s?(ua)+)? with the states that a system, user or assistant row leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTING = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


def spoken(state: int) -> tuple[str, int]:
    """The only role that an edit can give in ``state``, and the state it leads to."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def ways_through(rows: str, begin: int, accept: bool = False) -> list[tuple[int, str] | None]:
    """Cheapest (cost, audit) from state ``begin`` through ``rows`` to each state, ties by audit.

    A row is its role's initial, upper case if truncated, ``-`` if it must go and ``?``
    if its role is none of the grammar.  With ``accept`` the search stops at the first
    accepting end node, and no other end is given.
    """
    best: list[tuple[int, str] | None] = [None] * 4
    queue, done, open_ends = [(0, "", 0, begin)], set(), 4
    while queue and open_ends:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            best[state] = (cost, audit)
            open_ends -= 1
            if accept and state in ACCEPTING:
                return [best[s] if s == state else None for s in range(4)]
        else:
            row = rows[at]
            heapq.heappush(queue, (cost + DELETE, audit + "D", at + 1, state))
            if row != "-":
                more = TRUNCATED if row.isupper() or row == "!" else 0
                kept = AFTER[state].get(row.lower())
                if kept is not None:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, kept))
                heapq.heappush(queue, (cost + more + REROLE, audit + "R", at + 1, spoken(state)[1]))
        heapq.heappush(queue, (cost + INSERT, audit + "I", at, spoken(state)[1]))
    return best


def join_ways(pieces: list[list[list[tuple[int, str] | None]]]) -> tuple[int, str]:
    """Cheapest (cost, audit) through pieces in order; each piece has its ways by begin and end state.

    Two ways of one cost to one state read as many rows and insert as many, so neither
    audit begins with the other and the smaller one stays smaller whatever follows.
    """
    now: list[tuple[int, str] | None] = [(0, ""), None, None, None]
    for ways in pieces:
        then: list[tuple[int, str] | None] = [None] * 4
        for begin in range(4):
            for end in range(4):
                if now[begin] is not None and ways[begin][end] is not None:
                    way = (now[begin][0] + ways[begin][end][0], now[begin][1] + ways[begin][end][1])
                    then[end] = way if then[end] is None else min(then[end], way)
        now = then
    return min(now[s] for s in ACCEPTING if now[s] is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the rows after damage by the hash of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    hurt = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


#: Conversations by keys that are never null.
KEYS = ["none", "conv"]


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"none": F.col("conv_id").isNull(), "conv": F.coalesce("conv_id", F.lit(0)).cast("long")})


def sequenced(rows: DataFrame) -> DataFrame:
    """Damaged rows plus ``at``, which grows in the order of conversation, turn, role and text; written once."""
    order = [*KEYS, F.col("turn").asc_nulls_first(), "role"]
    dealt = keyed(rows).repartitionByRange(*order, F.substring("text", 1, DEALT_CHARS)).sortWithinPartitions(*order, "text")
    return materialize(dealt.select(*KEYS, "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")


def judged(turns: DataFrame) -> DataFrame:
    """Each row with its fault (blank, duplicate, truncated or null) and its role's initial."""
    said = F.struct("role", F.sha2("text", 256))
    firsts = turns.groupBy(*KEYS, said.alias("said")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    bare = F.rtrim(F.translate("text", SPACE, " " * len(SPACE)))
    fault = F.when(bare == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return turns.join(firsts, "at", "left").select(*KEYS, "at", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def code_of(fault: Column, initial: Column) -> Column:
    """One character per row, as :func:`ways_through` reads them."""
    gone, cut = fault.isin("blank", "duplicate"), fault == "truncated"
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    return F.when(gone, "-").when(cut, F.translate(known, "sua?", "SUA!")).otherwise(known)


WAY = "struct<cost: long, audit: string>"


def piece_ways(rows: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    none = [None] * 4

    def of(codes: str, first: bool, last: bool) -> list:
        return [ways_through(codes, begin, first and last) if not first or begin == START else none for begin in range(4)]

    return pd.Series([of(*x) for x in zip(rows, first, last)])


def joined_ways(pieces: pd.Series) -> pd.DataFrame:
    def way(w: dict | None) -> tuple[int, str] | None:
        return None if w is None else (w["cost"], w["audit"])

    found = [join_ways([[[way(w) for w in ends] for ends in p["ways"]] for p in ps]) for ps in pieces]
    return pd.DataFrame(found, columns=["cost", "audit"])


def repaired_hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of conversations, each led by a row with its audit -> (none, conv, repaired_sha256).

    Rows are hashed as they come; a task holds one batch and one audit.
    """
    here, digest, audit, at, state, started = None, None, "", 0, START, False

    def add(line: str) -> None:
        nonlocal started
        digest.update((("\n" if started else "") + line).encode())
        started = True

    def insertions() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = spoken(state)
            add(f"{role}:")
            at += 1

    def ended() -> list[tuple[bool, int, str]]:
        if here is None:
            return []
        insertions()
        return [(*here, digest.hexdigest())]

    for frame in frames:
        out = []
        for none, conv, audit_here, role, text in zip(frame["none"], frame["conv"], frame["audit"], frame["role"], frame["text"]):
            if (none, conv) != here:
                out += ended()
                here, digest, audit, at, state, started = (none, conv), hashlib.sha256(), audit_here, 0, START, False
                continue
            insertions()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = AFTER[state][role[0]]
            elif edit == "R":
                role, state = spoken(state)
            if edit != "D":
                add(f"{role}:{text}")
        yield pd.DataFrame(out, columns=["none", "conv", "repaired_sha256"])
    yield pd.DataFrame(ended(), columns=["none", "conv", "repaired_sha256"])


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per conversation: faults, cheapest edits and the hash of what they leave."""
    ids = keyed(conversations.select("conv_id")).select("conv_id", *KEYS).distinct()
    turns = sequenced(damaged(conversations))

    gaps = turns.groupBy(*KEYS).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    row = F.struct("at", code_of(F.col("fault"), F.col("initial")).alias("code"), "initial")
    count = lambda fault: F.count_if(F.coalesce(F.col("fault") == fault, F.lit(False))).alias(fault)
    place = F.struct(F.shiftright("at", 33).alias("part"), F.expr(f"(at & {(1 << 33) - 1}) div {PIECE}").alias("block"))
    grouped = judged(turns).groupBy(*KEYS, place.alias("piece")).agg(count("blank"), count("duplicate"), count("truncated"), F.array_sort(F.collect_list(row)).alias("rows"))
    legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    inside = F.size(F.filter(F.sequence(F.lit(1), F.size("rows") - 1), lambda k: ~legal(F.col("rows")[k - 1]["initial"], F.col("rows")[k]["initial"])))
    pieces = grouped.select(
        *KEYS,
        "piece",
        "blank",
        "duplicate",
        "truncated",
        F.when(F.size("rows") > 1, inside).otherwise(0).alias("inside"),
        F.concat_ws("", "rows.code").alias("codes"),
        F.col("rows")[0]["initial"].alias("begins"),
        F.element_at("rows", -1)["initial"].alias("ends"),
    )
    pieces = materialize(pieces, "pieces")

    solve, join = F.pandas_udf(piece_ways, f"array<array<{WAY}>>"), F.pandas_udf(joined_ways, WAY)
    outer = pieces.groupBy(*KEYS).agg(F.min("piece").alias("first"), F.max("piece").alias("last"))
    solved = pieces.join(outer, KEYS).withColumn("ways", solve("codes", F.col("piece") == F.col("first"), F.col("piece") == F.col("last")))
    told = F.struct("piece", "begins", "ends", "ways")
    whole = solved.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "inside")], F.array_sort(F.collect_list(told)).alias("pieces"))
    seams = F.size(F.filter(F.sequence(F.lit(1), F.size("pieces") - 1), lambda k: ~legal(F.col("pieces")[k - 1]["ends"], F.col("pieces")[k]["begins"])))
    whole = whole.select(
        *KEYS, "blank", "duplicate", "truncated", (F.col("inside") + F.when(F.size("pieces") > 1, seams).otherwise(0)).alias("illegal"), join("pieces").alias("way")
    )
    whole = materialize(whole, "ways")

    audits = whole.select(*KEYS, F.lit(-1).cast("long").alias("at"), F.col("way.audit").alias("audit"), F.lit("").alias("role"), F.lit("").alias("text"))
    lines = turns.select(*KEYS, "at", F.lit(None).cast("string").alias("audit"), "role", "text")
    led = audits.unionByName(lines).repartition(*KEYS).sortWithinPartitions(*KEYS, "at")
    hashes = led.mapInPandas(repaired_hashes, "none boolean, conv long, repaired_sha256 string")

    out = ids.join(whole, KEYS, "left").join(gaps, KEYS, "left").join(hashes, KEYS, "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return out.select(
        "conv_id",
        *[zero(F.col(c), c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")],
        zero(F.col("way.cost"), "cost"),
        F.coalesce("way.audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )

"""Chat formatting with minimum-cost role repair.

Legal chats: an optional system turn first, then user and assistant in turn, an assistant at the end. Messages that break this
are repaired at least cost: a message keeps its role or gets another (``RELABEL``, ``UNKNOWN`` if its role is none of the
three), is merged into the turn before it if both have one role (``MERGE``), or an empty turn goes before it (``INSERT``), as
after the last one. The automaton's state is the role of the last turn, so a message is a 4 x 4 table of costs and
dynamic programming is a product of tables in min-plus algebra.

Messages are put in order by ranges of (chat, turn, role, text hash), so a chat of any size is spread over many tasks, whatever its turns
are called. Within a task's range each chat is cut into blocks of ``BLOCK`` messages. A chat of one block is solved where it is; of longer
ones each block's product is made in parallel, then the product of each range's blocks; the best states at the ranges' edges follow from
these, those at the blocks' edges from the ranges', and then each block is solved between its edges. One row for each message is
returned; ``rendered`` of a chat's rows, in order of ``block`` and ``seq``, is the chat.

Messages go by turn (nulls first), then role and hash of the text. Null texts are empty, null roles are unknown; rows without
a chat id form one chat. Repeated rows are messages of their own; very long texts are rendered whole. Ties go to the option listed
first. Other columns are not read.
"""

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table, written

ROLES = ["system", "user", "assistant"]
NONE = 3
#: Costs of the repairs (parameters).
RELABEL, UNKNOWN, MERGE, INSERT = 2.0, 1.0, 1.0, 1.5
BLOCK = 1024
NEXT = {NONE: (0, 1), 0: (1,), 1: (2,), 2: (1,)}


def options(role):
    """``{(state, next state): (cost, action, inserted role)}`` of a message; each entry's cheapest."""
    found = {}
    for to in range(3):
        relabel = 0.0 if ROLES[to] == role else RELABEL if role in ROLES else UNKNOWN
        name = "keep" if ROLES[to] == role else "relabel"
        for s in range(4):
            ways = []
            if to in NEXT[s]:
                ways.append((relabel, name, None))
            if s == to:
                ways.append((relabel + MERGE, "merge" if name == "keep" else "relabel+merge", None))
            ways += [(relabel + INSERT, "insert" if name == "keep" else "relabel+insert", x) for x in NEXT[s] if to in NEXT[x]]
            if ways:
                found[s, to] = min(ways, key=lambda w: w[0])
    return found


OPTIONS = {role: options(role) for role in [*ROLES, ""]}


def table_of(role):
    m = np.full((4, 4), np.inf)
    for (s, to), way in OPTIONS[role].items():
        m[s, to] = way[0]
    return m


TABLES = {role: table_of(role) for role in OPTIONS}
#: Cost of ending in a state: a user or system turn needs an answer after it.
END = np.array([2 * INSERT, INSERT, 0.0, 0.0])


def product(roles):
    """Costs of a block from each state to each state."""
    m = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        m = (m[:, :, None] + TABLES[role][None]).min(axis=1)
    return m


def chained(products):
    """The product of a list of blocks' products."""
    out = products[0]
    for m in products[1:]:
        out = (out[:, :, None] + m[None]).min(axis=1)
    return out


def edges(products, entry=NONE, leave=None):
    """The state before each block and after the last, by least cost over all blocks."""
    best, back = np.full(4, np.inf), []
    best[entry] = 0.0
    for m in products:
        into = best[:, None] + m
        back.append(into.argmin(axis=0))
        best = into.min(axis=0)
    states = [int((best + END).argmin()) if leave is None else int(leave)]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def solved(roles, entry=NONE, leave=None):
    """The states after each message, from an entry state to a leaving one (by end cost if None)."""
    best, back = np.full(4, np.inf), []
    best[entry] = 0.0
    for role in roles:
        into = best[:, None] + TABLES[role]
        back.append(into.argmin(axis=0))
        best = into.min(axis=0)
    state = int((best + END).argmin()) if leave is None else int(leave)
    states = []
    for b in reversed(back):
        states.append(state)
        state = int(b[state])
    return states[::-1]


def escaped(text):
    return (text or "").replace("<|", "< |")


def turn(role, text):
    return f"<|start|>{ROLES[role]}\n{text}"


def rows_of(roles, texts, entry, leave, final):
    """(new role, action, cost, rendered) of each message of a block."""
    out, before = [], entry
    states = solved(roles, entry, leave)
    for k, (role, text, to) in enumerate(zip(roles, texts, states)):
        cost, action, inserted = OPTIONS[role][before, to]
        if "merge" in action:
            shown = "\n" + escaped(text)
        else:
            shown = "<|end|>\n" if before != NONE else ""
            shown += f"{turn(inserted, '')}<|end|>\n" if inserted is not None else ""
            shown += turn(to, escaped(text))
        if final and k == len(roles) - 1:
            shown += "<|end|>\n"
            cost += END[to]
            shown += "".join(f"{turn(x, '')}<|end|>\n" for x in range(to + 1, 3))
            action += "+answer" if to < 2 else ""
        out.append((ROLES[to], action, float(cost), shown))
        before = to
    return out


def known(role):
    return role if role in ROLES else ""


TEXT = ("conv_id", "turn", "role", "text")
NUMBERED = T.StructType([*[T.StructField(c, T.StringType()) for c in TEXT], *[T.StructField(c, T.LongType()) for c in ("range", "block", "seq")]])


def numbered(messages: DataFrame, size: int) -> DataFrame:
    """A written table of the messages in order: ``range`` (the task's), ``block`` (ascending within a chat) and ``seq`` within the block."""
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = messages.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_text", "_row"]
    rows = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*[F.col(c).cast("string") for c in TEXT])

    def number(batches):
        here, last, block, at = TaskContext.get().partitionId(), (), -1, 0
        for batch in batches:
            conv = batch["conv_id"]
            edges_ = np.flatnonzero((conv.ne(conv.shift()) & ~(conv.isna() & conv.shift().isna())).to_numpy())
            starts = sorted({0, *edges_.tolist()}) if len(batch) else []
            blocks, seqs = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for lo, hi in zip(starts, [*starts[1:], len(batch)]):
                own = conv.iloc[lo]
                own = None if pd.isna(own) else own
                if (own,) != last:
                    last, block, at = (own,), block + 1, 0
                place = at + np.arange(hi - lo)
                blocks[lo:hi], seqs[lo:hi] = block + place // size, place % size
                block, at = block + int(place[-1]) // size, int(place[-1]) % size + 1
                if at == size:
                    block, at = block + 1, 0
            yield batch.assign(range=here, block=(here << 32) + blocks, seq=seqs)

    return written(rows.mapInPandas(number, NUMBERED))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def block_cost(roles: pd.Series) -> pd.Series:
    return pd.Series([product(map(known, r)).ravel() for r in roles])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def range_cost(costs: pd.Series) -> pd.Series:
    return pd.Series([chained(np.array(c).reshape(-1, 4, 4)).ravel() for c in costs])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def states(costs: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
    return pd.Series([edges(np.array(c).reshape(-1, 4, 4), int(e), None if pd.isna(x) else x) for c, e, x in zip(costs, entry, leave)])


def planned(rows: DataFrame) -> DataFrame:
    """``(block, entry, leave, final)`` of the blocks of chats that have more than one."""
    spans = rows.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    long = written(spans.filter("first < last").select(F.col("conv_id").alias("_long"), "last"))
    cut = rows.select("conv_id", "range", "block", "seq", "role").join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left_semi")
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    blocks = written(cut.groupBy("conv_id", "range", "block").agg(in_order("seq", "role").alias("roles")).select("conv_id", "range", "block", block_cost("roles").alias("costs")))
    ranges = blocks.groupBy("conv_id", "range").agg(F.array_sort(F.collect_list("block")).alias("blocks"), F.flatten(in_order("block", "costs")).alias("costs"))
    ranges = written(ranges.withColumn("cost", range_cost("costs")))
    none = F.lit(None).cast("int")
    chats = ranges.groupBy("conv_id").agg(F.array_sort(F.collect_list("range")).alias("ranges"), F.flatten(in_order("range", "cost")).alias("costs"))  # a few numbers for each of the ranges
    chats = chats.select("ranges", F.col("conv_id").alias("_chat"), states("costs", F.lit(NONE), none).alias("s"))
    of_range = chats.select("_chat", F.posexplode("ranges").alias("k", "_range"), "s").select("_chat", "_range", F.expr("s[k]").alias("entry"), F.expr("s[k + 1]").alias("leave"))
    of_range = written(of_range)
    inner = ranges.join(of_range, F.col("conv_id").eqNullSafe(F.col("_chat")) & (F.col("range") == F.col("_range"))).select("conv_id", "blocks", states("costs", "entry", "leave").alias("s"))
    each = inner.select("conv_id", F.posexplode("blocks").alias("k", "block"), "s").select("conv_id", "block", F.expr("s[k]").alias("entry"), F.expr("s[k + 1]").alias("leave"))
    return each.join(long, F.col("conv_id").eqNullSafe(F.col("_long"))).select("block", "entry", "leave", (F.col("block") == F.col("last")).alias("final"))


OUT = T.StructType([*[T.StructField(c, T.StringType()) for c in ("conv_id", "turn", "role")], T.StructField("block", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("new_role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("cost", T.DoubleType()), T.StructField("rendered", T.StringType())])


FIELDS = [*TEXT, "block", "seq", "entry", "leave", "final"]


def blocks_of(batches):
    """The columns of each block, as lists; sorted batches may cut a block, of which what has come is held."""
    held = None
    for batch in batches:
        columns = [batch[c].tolist() for c in FIELDS]
        columns = columns if held is None else [h + c for h, c in zip(held, columns)]
        edges_ = [0, *(np.flatnonzero(np.diff(columns[4])) + 1).tolist()]
        for lo, hi in zip(edges_, edges_[1:]):
            yield [c[lo:hi] for c in columns]
        held = [c[edges_[-1] :] for c in columns]
    if held and held[0]:
        yield held


def repair(batches):
    pack = []
    for conv, turns, roles, texts, block, seq, entry, leave, final in blocks_of(batches):
        inside = not pd.isna(entry[0])
        ends = (int(entry[0]), int(leave[0])) if inside else (NONE, None)
        done = rows_of(list(map(known, roles)), texts, *ends, not inside or bool(final[0]))
        pack += [(*own, *x) for own, x in zip(zip(conv, turns, roles, block, seq), done)]
        if len(pack) >= 2000:
            yield pd.DataFrame(pack, columns=OUT.names)
            pack = []
    yield pd.DataFrame(pack, columns=OUT.names)


def repaired(messages: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> the same rows with ``new_role``, ``action``, ``cost`` and ``rendered``; ``block`` and ``seq`` order them."""
    session(messages)
    own = messages.select(*TEXT)
    rows = numbered(own, size)
    whole = rows.join(written(planned(rows)), "block", "left")
    done = whole.repartition("block").sortWithinPartitions("block", "seq").mapInPandas(repair, OUT)
    return done.withColumns({c: F.col(c).cast(own.schema[c].dataType) for c in ("conv_id", "turn")})


def op5_role_repair(spark, sf_dir):
    return repaired(table(spark, sf_dir, "conversations"))

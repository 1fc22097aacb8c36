"""Event sequences of processes, their sessions and texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.tokens import node_tokens
from tracegrain.model import EDGE_KEY, TIME_SLICE, ProvGraph

GAP, MOST_TOKENS = 10_000, 510
#: Events whose texts are given out together.
TEXT_ROWS = 500


def process_events(graph: ProvGraph) -> DataFrame:
    """The events at each process, a self-loop once: (process, node_ord, and the event's columns)."""
    ends = graph.edges.withColumn("process", F.explode(F.array_distinct(F.array("src", "dst"))))
    processes = graph.nodes.where("type = 'process'").select(F.col("node").alias("process"), "node_ord")
    return ends.join(processes, "process").select("process", "node_ord", *graph.edges.columns)


def sessions(events: DataFrame, gap: float = GAP, slice: float = TIME_SLICE) -> DataFrame:
    """Events with session_no and event_no, from 0: a session ends at a pause of ``gap`` or more.

    A process is numbered slice of time by slice of time, so one that holds many
    events is many tasks; a row a slice carries on what came before. The width
    of the slices has no influence on the result. Null times come first and
    break nothing.
    """
    cut = F.coalesce(F.floor(F.col("start_time") / slice).cast("long"), F.lit(-(1 << 63)))
    pause = F.coalesce((F.col("start_time") - F.lag("start_time").over(Window.partitionBy("process", "slice").orderBy("start_time")) >= gap), F.lit(False))
    place = F.row_number().over(Window.partitionBy("process", "slice").orderBy("start_time")).cast("long") - 1
    found = events.select("process", "start_time", cut.alias("slice")).withColumn("new", pause).withColumn("place", place)
    first, last = F.min("start_time").alias("first"), F.max("start_time").alias("last")
    parts = found.groupBy("process", "slice").agg(F.count(F.lit(1)).alias("n"), first, last, F.count_if("new").alias("breaks"), F.max(F.when(F.col("new"), F.col("place"))).alias("break_at"))
    order = Window.partitionBy("process").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("opens", F.coalesce(F.col("first") - F.lag("last").over(order) >= gap, F.lit(False))).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begun = F.coalesce(F.col("base") + F.col("break_at"), F.when(F.col("opens"), F.col("base")))
    carried = parts.select(
        "process",
        "slice",
        "base",
        (F.coalesce(F.sum("breaks").over(before), F.lit(0)) + F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("session_base"),
        F.when(F.col("opens"), F.col("base")).otherwise(F.coalesce(F.max(begun).over(before), F.lit(0))).alias("begun"),
    )
    inside = Window.partitionBy("process", "slice").orderBy("start_time", "edge_ord")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("start_time") - F.lag("start_time").over(inside) >= gap, F.lit(False))
    rows = events.withColumn("slice", cut).join(carried, ["process", "slice"]).withColumn("new", new).withColumn("at", F.col("base") + F.row_number().over(inside) - 1)
    begin = F.coalesce(F.max(F.when(F.col("new"), F.col("at"))).over(upto), F.col("begun"))
    rows = rows.withColumn("session_no", F.col("session_base") + F.sum(F.col("new").cast("long")).over(upto)).withColumn("event_no", F.col("at") - begin)
    return rows.select(*events.columns, "session_no", "event_no")


def vocabulary_of_nodes(graph: ProvGraph) -> DataFrame:
    """(node, type, tokens, flag); flag is not 0 where a name doesn't have the shape of its type."""
    return graph.nodes.withColumn("t", node_tokens(F.col("node"), F.col("type"))).select("node", "type", "t.tokens", "t.flag")


def vocabulary(graph: ProvGraph) -> DataFrame:
    """Distinct non-empty tokens of all nodes, and edge types: (word)."""
    words = vocabulary_of_nodes(graph).select(F.explode("tokens").alias("word")).union(graph.edges.select("type"))
    return words.where("word <> ''").distinct()


def event_texts(events: DataFrame, tokens: DataFrame, gap: float = GAP, most: int = MOST_TOKENS) -> DataFrame:
    """The growing texts of sessions: (process, node_ord, session_no, event_no, piece_no, text), all that are offered.

    Each event adds the tokens of its source, its type, and the tokens of its
    target. If that would exceed ``most`` tokens, the text so far is offered
    again (piece 0) and a new text starts with the event and a leading blank
    (piece 1). Events whose nodes have no entry in ``tokens`` are skipped.

    Where a text ends depends on where the one before ended, so a session
    streams by in order; only the text so far is held, ``most`` tokens or one event.
    """
    names = tokens.select("node", "tokens")
    found = sessions(events, gap).join(names.select(F.col("node").alias("src"), F.col("tokens").alias("u")), "src").join(names.select(F.col("node").alias("dst"), F.col("tokens").alias("v")), "dst")
    words = F.concat("u", F.array("type"), "v")
    # a blank before each word
    rows = found.where(words.isNotNull()).select("process", "node_ord", "session_no", "event_no", F.size(words).alias("n"), F.concat(F.lit(" "), F.array_join(words, " ")).alias("more"))
    ordered = rows.repartition("process", "session_no").sortWithinPartitions("process", "session_no", "event_no")

    def grow(batches):
        session, text, held = None, "", 0
        for whole in batches:
            for start in range(0, whole.num_rows, TEXT_ROWS):
                b = whole.slice(start, TEXT_ROWS)
                at, pieces, offers = [], [], []
                for i, (process, number, n, more) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 4, 5)), strict=True)):
                    if (process, number) != session:
                        session, text, held = (process, number), "", 0
                    if held >= most or held + n > most:
                        at += (i, i)
                        pieces += (0, 1)
                        offers += (text, more)
                        text, held = more, n
                    else:
                        text, held = (text + more).strip(), held + n
                        at.append(i)
                        pieces.append(0)
                        offers.append(text)
                keys = b.select([0, 1, 2, 3]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(pieces, pa.int32()), pa.array(offers, pa.string())], names=[*keys.schema.names, "piece_no", "text"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields[:4])
    return ordered.mapInArrow(grow, f"{kept}, piece_no int, text string")


def session_texts(events: DataFrame, tokens: DataFrame, gap: float = GAP, most: int = MOST_TOKENS) -> DataFrame:
    """``event_texts``, each text only where it first comes up over all processes in node order."""
    order = Window.partitionBy("text").orderBy("node_ord", "session_no", "event_no", "piece_no")
    return event_texts(events, tokens, gap, most).withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def event_text_map(events: DataFrame, tokens: DataFrame, gap: float = GAP, most: int = MOST_TOKENS, distinct: bool = False, last_process: bool = True) -> DataFrame:
    """(src, dst, key, texts): the texts offered at each event; of two processes the later in node order, unless all are asked for."""
    texts = session_texts(events, tokens, gap, most) if distinct else event_texts(events, tokens, gap, most)
    at = sessions(events, gap).select("process", "session_no", "event_no", *EDGE_KEY)
    rows = texts.join(at, ["process", "session_no", "event_no"]).groupBy(*EDGE_KEY, "node_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda x: x["text"]).alias("texts"))
    if last_process:
        return rows.groupBy(*EDGE_KEY).agg(F.max_by("texts", "node_ord").alias("texts"))
    return rows.groupBy(*EDGE_KEY).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "texts"))), lambda x: x["texts"])).alias("texts"))


def session_lists(events: DataFrame, gap: float = GAP) -> DataFrame:
    """(process, session_no, events): each session's (src, dst, type) in time order."""
    item = F.struct("event_no", "src", "dst", "type")
    listed = sessions(events, gap).groupBy("process", "session_no").agg(F.array_sort(F.collect_list(item)).alias("e"))
    return listed.select("process", "session_no", F.transform("e", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), x["type"].alias("type"))).alias("events"))


def truth_sequences(attack: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events of processes that attack events touch, with those events added (twice for a self-loop), and without."""
    processes = events.select("process", "node_ord").distinct()
    more = attack.withColumn("process", F.explode(F.array("src", "dst"))).join(processes, "process").select(events.columns)
    touched = more.select("process").distinct()
    plain = events.join(touched, "process", "left_semi").select(events.columns)
    return plain.unionByName(more), plain


def truth_only(truth_texts: DataFrame, plain_texts: DataFrame) -> DataFrame:
    """(process, texts) lists of the first that are no process's list in the second."""
    return truth_texts.join(plain_texts.select("texts").distinct(), "texts", "left_anti").select(truth_texts.columns)

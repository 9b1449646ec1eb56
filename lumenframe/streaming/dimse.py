"""DIMSE messages as rows: commands, reassembly of fragments, progress of sub-operations."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import KEYWORD
from ..sources.encode import Node, Writer
from ..sources.parse import Element, ReadOptions, _Reader

NO_DATA_SET, DATA_SET = 0x0101, 0x0000


def reassemble(pdvs: DataFrame) -> DataFrame:
    """(assoc, ctx, message, n_fragments, n_bytes, payload): fragments (.., seq, last, data) put together in order.

    A message counts once its last fragment is there.
    """
    parts = pdvs.groupBy("assoc", "ctx", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("p"), F.bool_or("last").alias("whole")).where("whole")  # one message's fragments
    return parts.select("assoc", "ctx", "message", F.size("p").alias("n_fragments"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["data"])).alias("n_bytes"), F.concat_ws("", F.transform("p", lambda x: x["data"])).alias("payload"))


def progress(sub_operations: DataFrame, key: str = "assoc", order: tuple[str, ...] = ("ts", "event_id"), status: str = "category") -> DataFrame:
    """sub_operations with completed, failed, warning and remaining as they stand after each."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = lambda c: F.count_if(F.col(status) == c).over(run)
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    done = F.count(F.lit(1)).over(run)
    return sub_operations.select("*", n("Success").alias("completed"), n("Failure").alias("failed"), n("Warning").alias("warning"), (total - done).alias("remaining"), (total == done).alias("final"))


def command(field: int, message: int, **values: object) -> bytes:
    """A command set in bytes: elements by keyword, integers or text, after the group length."""
    rows = {"CommandField": field, **({"MessageIDBeingRespondedTo": message} if field & 0x8000 else {"MessageID": message}), **values}
    w = Writer(explicit=False)
    nodes = [Node(KEYWORD[k], "US" if isinstance(v, int) else "UI", struct.pack("<H", v) if isinstance(v, int) else str(v).encode()) for k, v in rows.items()]
    body = w.dataset(nodes)
    return w.element(Node(0, "UL", struct.pack("<I", len(body)))) + body


def echo_request(message: int) -> bytes:
    return command(0x0030, message, AffectedSOPClassUID="1.2.840.10008.1.1", CommandDataSetType=NO_DATA_SET)


def store_request(message: int, sop_class: str, sop_instance: str, priority: int = 0) -> bytes:
    return command(0x0001, message, AffectedSOPClassUID=sop_class, AffectedSOPInstanceUID=sop_instance, Priority=priority, CommandDataSetType=DATA_SET)


def find_request(message: int, sop_class: str, priority: int = 0) -> bytes:
    return command(0x0020, message, AffectedSOPClassUID=sop_class, Priority=priority, CommandDataSetType=DATA_SET)


def move_request(message: int, sop_class: str, destination: str, priority: int = 0) -> bytes:
    return command(0x0021, message, AffectedSOPClassUID=sop_class, MoveDestination=destination, Priority=priority, CommandDataSetType=DATA_SET)


def get_request(message: int, sop_class: str, priority: int = 0) -> bytes:
    return command(0x0010, message, AffectedSOPClassUID=sop_class, Priority=priority, CommandDataSetType=DATA_SET)


def cancel_request(message: int) -> bytes:
    """A cancel names the message it stops, like a response, but its field is a request's."""
    w = Writer(explicit=False)
    nodes = [Node(KEYWORD[k], "US", struct.pack("<H", v)) for k, v in (("CommandField", 0x0FFF), ("MessageIDBeingRespondedTo", message), ("CommandDataSetType", NO_DATA_SET))]
    body = w.dataset(nodes)
    return w.element(Node(0, "UL", struct.pack("<I", len(body)))) + body


def response(request_field: int, message: int, status: int, **values: object) -> bytes:
    return command(request_field | 0x8000, message, Status=status, CommandDataSetType=NO_DATA_SET, **values)


def read_command(data: bytes) -> list[Element]:
    return _Reader(memoryview(data), False, False, ReadOptions()).dataset(0, len(data), (), "ascii", {})[0]

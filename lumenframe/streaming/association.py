"""The association state machine: replayed over ordered events in a batch, or kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE, ESTABLISHED = 1, 6
ANY = 0
# Fixed values: (state, event, next state) of the upper-layer protocol; state 0 stands for any state.
TRANSITIONS = [
    (1, "a_associate_request", 4), (1, "transport_indication", 2),
    (2, "associate_rq_pdu", 3), (2, "artim_expired", 1), (2, "invalid_pdu", 1),
    (3, "a_associate_response", 6), (3, "a_associate_reject", 1),
    (4, "transport_confirm", 5), (4, "transport_close", 1),
    (5, "associate_ac_pdu", 6), (5, "associate_rj_pdu", 1), (5, "invalid_pdu", 1),
    (6, "p_data_request", 6), (6, "p_data_pdu", 6), (6, "a_release_request", 7), (6, "release_rq_pdu", 8), (6, "invalid_pdu", 1),
    (7, "release_rp_pdu", 13), (7, "release_rq_pdu", 9),
    (8, "a_release_response", 13), (8, "a_release_request", 10),
    (9, "release_rp_pdu", 11), (10, "a_release_response", 12), (11, "a_release_response", 13), (12, "release_rp_pdu", 13),
    (13, "artim_expired", 1),
    (ANY, "abort_pdu", 1), (ANY, "a_abort_request", 1), (ANY, "transport_close", 1),
]
#: States in which the ARTIM timer runs.
TIMED = (2, 13)
#: Protocol events of what an acceptor sees.
ACCEPTOR = {"connect": ["transport_indication", "associate_rq_pdu", "a_associate_response"], "pdata": ["p_data_pdu"], "release": ["release_rq_pdu", "a_release_response", "transport_close"], "abort": ["abort_pdu"]}
TABLE = {(s, e): n for s, e, n in TRANSITIONS}


def step(state: int, event: str) -> int | None:
    """The next state; None if the event is an error in this state."""
    found = TABLE.get((state, event), TABLE.get((ANY, event)))
    return None if event == "transport_close" and state == IDLE else found


def _next(state: Column, event: Column) -> Column:
    table = F.create_map(*[x for (s, e), n in TABLE.items() for x in (F.lit(f"{s} {e}"), F.lit(n))])
    own = F.try_element_at(table, F.concat(state.cast("string"), F.lit(" "), event))
    general = F.try_element_at(table, F.concat(F.lit(f"{ANY} "), event))
    return F.when((event == "transport_close") & (state == IDLE), None).otherwise(F.coalesce(own, general))


def protocol_events(event: Column) -> Column:
    table = F.create_map(*[x for k, v in ACCEPTOR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(table, event)


def replay(events: DataFrame, key: str = "assoc", order: tuple[str, ...] = ("ts", "event_id"), event: str = "event") -> DataFrame:
    """(key, n_events, state, errors): the state each association ends in; an event that isn't allowed changes nothing."""
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("event")))).alias("e"))  # one association's events
    steps = F.flatten(F.transform("e", lambda x: protocol_events(x["event"])))
    start = F.struct(F.lit(IDLE).alias("state"), F.lit(0).alias("errors"))

    def apply(acc: Column, e: Column) -> Column:
        return F.transform(F.array(_next(acc["state"], e)), lambda n: F.struct(F.coalesce(n, acc["state"]).alias("state"), (acc["errors"] + n.isNull().cast("int")).alias("errors")))[0]

    return rows.select(key, F.size("e").cast("long").alias("n_events"), F.aggregate(steps, start, apply).alias("r")).select(key, "n_events", "r.state", "r.errors")


def stream_states(events: DataFrame, artim_ms: int | None = None) -> DataFrame:
    """The same over a stream of (assoc, ts, event_id, event): a row an association and batch.

    artim_ms makes the ARTIM timer a timeout of the state; such a query runs on and on, so it is none for availableNow.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, errors, n = state.get if state.exists else (IDLE, 0, 0)
        if state.hasTimedOut:
            now = step(now, "artim_expired") or now
        rows = [b for b in batches if len(b)]
        if rows:
            for e in pd.concat(rows).sort_values(["ts", "event_id"])["event"]:
                n += 1
                for x in ACCEPTOR[e]:
                    after = step(now, x)
                    now, errors = (now, errors + 1) if after is None else (after, errors)
        state.update((now, errors, n))
        if artim_ms is not None and now in TIMED:
            state.setTimeoutDuration(artim_ms)
        yield pd.DataFrame({"assoc": [key[0]], "n_events": [n], "state": [now], "errors": [errors]})

    return events.groupBy("assoc").applyInPandasWithState(run, "assoc long, n_events long, state int, errors int", "state int, errors int, n long", "update", "NoTimeout" if artim_ms is None else "ProcessingTimeTimeout")


def sessions(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """(assoc, start, end, n): runs of events no further apart than the gap; in a stream, after a watermark."""
    w = F.session_window("ts", gap)
    return events.groupBy("assoc", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("assoc", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

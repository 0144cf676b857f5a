"""Alert suppression (T3): first alert of a subject goes out, then only alerts at least
``cooldown`` after the last one that went out.

The rule is greedy, so each decision depends on the one before. A subject's timeline is cut into
pieces of about equal row count that are worked on in parallel: a piece is first reduced to "if the
last alert went out at L, the last one of this piece goes out at E" (a short step table, because
nearby starts run together), those tables are chained per subject, and then every piece is replayed
from its known start. A subject with most of all alerts lies in many pieces, and the chain it leaves
is one small table per piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.operators.ordering import cut_by_rows

MICROS = 1_000_000
NEVER = np.iinfo(np.int64).min // 2


def last_of_runs(t: np.ndarray, cooldown: int) -> np.ndarray:
    """For each start index, index of the last alert sent by the greedy run that sends it."""
    n = len(t)
    following = np.append(np.searchsorted(t, t + cooldown), n)
    last = np.append(np.where(following[:n] == n, np.arange(n), following[:n]), n)
    while True:  # pointer doubling: as many rounds as the logarithm of the longest run
        jumped = last[last]
        if np.array_equal(jumped, last):
            return last[:n]
        last = jumped


def step_table(t: np.ndarray, start: int, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """(latest due time, last sent) steps of one period; ``due`` is last sent plus cooldown."""
    entries = min(int(np.searchsorted(t, start + cooldown)) + 1, len(t))
    last = t[last_of_runs(t, cooldown)[:entries]]
    keep = np.append(last[1:] != last[:-1], True)
    return t[:entries][keep], last[keep]


def replay(t: np.ndarray, due: int, cooldown: int) -> list[int]:
    """Alerts sent in one period; at most the period length divided by the cooldown."""
    sent = []
    i = int(np.searchsorted(t, due))
    while i < len(t):
        sent.append(int(t[i]))
        i = int(np.searchsorted(t, t[i] + cooldown))
    return sent


def suppress_alerts(alerts: DataFrame, cooldown_seconds: int = 300) -> DataFrame:
    """T3 in batch over ``alerts(seq, ts, subject)``: the alerts that go out."""
    cooldown = cooldown_seconds * MICROS
    stamped = alerts.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    # Equal times of a subject act as one; only the time column travels to the workers.
    times = cut_by_rows(stamped.select("subject", "t").distinct(), ["subject", "t"], "piece")

    def steps(key, rows):
        t = np.sort(rows["t"].to_numpy())
        due, last = step_table(t, int(t[0]), cooldown)
        return pd.DataFrame({"subject": key[0], "piece": key[1], "due": due, "last": last})

    def chain(key, rows):
        out, sent = [], NEVER
        for number, table in rows.sort_values(["piece", "due"]).groupby("piece", sort=True):
            out.append((key[0], number, sent + cooldown))
            hit = int(np.searchsorted(table["due"].to_numpy(), sent + cooldown))
            if hit < len(table):
                sent = int(table["last"].iloc[hit])
        return pd.DataFrame(out, columns=["subject", "piece", "from_due"])

    def send(key, rows):
        t = np.sort(rows["t"].to_numpy())
        return pd.DataFrame({"subject": key[0], "t": replay(t, int(rows["from_due"].iloc[0]), cooldown)}, columns=["subject", "t"])

    tables = times.groupBy("subject", "piece").applyInPandas(steps, "subject string, piece int, due long, last long")
    starts = tables.groupBy("subject").applyInPandas(chain, "subject string, piece int, from_due long")
    sent = times.join(starts, ["subject", "piece"]).groupBy("subject", "piece").applyInPandas(send, "subject string, t long")
    first = stamped.join(sent, ["subject", "t"], "left_semi").groupBy("subject", "t").agg(F.min_by(F.struct("seq", "ts"), "seq").alias("a"))
    return first.select("a.seq", "a.ts", "subject")


def fold_alerts(times: Iterator[int], last_sent: int | None, cooldown: int) -> tuple[list[int], int | None]:
    """The same rule over ordered times from a known last one (used per key in a stream)."""
    sent = []
    for t in times:
        if last_sent is None or t - last_sent >= cooldown:
            sent.append(t)
            last_sent = t
    return sent, last_sent

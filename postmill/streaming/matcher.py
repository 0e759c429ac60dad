"""Keyed state of the streaming draft-to-reply match, in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_US = 86_400_000_000
COLUMNS = ["thread_id", "draft_id", "message_id", "status", "event_ts"]


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS)
    frame["event_ts"] = pd.to_datetime(frame["event_ts"], unit="us")
    return frame


def settle(drafts: list[tuple[int, str]], replies: list[tuple[int, str]], upto: int, days: int) -> tuple[list[tuple], list[str]]:
    """Matches and expiries of one thread up to the time ``upto``: (draft_id, message_id, status, time), and the drafts that stay open.

    ``drafts`` and ``replies`` are (time, id) in microseconds, none after ``upto``. In time order, a reply takes the newest open
    draft that was made before or with it, at most ``days`` ago; of drafts made at once the lowest id.
    """
    made = sorted(drafts, key=lambda d: (-d[0], d[1]), reverse=True)  # oldest first, the lowest id last among equals
    open_, done, at = [], [], 0
    for when, message_id in sorted(replies):
        while at < len(made) and made[at][0] <= when:
            open_.append(made[at])
            at += 1
        if open_ and open_[-1][0] + days * DAY_US >= when:
            done.append((open_.pop()[1], message_id, "RECONCILED", when))
    rest = []
    for when, draft_id in open_ + made[at:]:
        limit = when + days * DAY_US
        if limit <= upto:
            done.append((draft_id, None, "ABANDONED", limit))
        else:
            rest.append(draft_id)
    return done, rest


class DraftMatcher(StatefulProcessor):
    """Open drafts and waiting replies of one thread, by id, with their times and nothing else.

    Events wait until the watermark has passed them, when all that came before them has arrived or is too late to
    count, and are then settled in time order. So the result depends neither on the order of arrival nor on where
    the stream is cut into batches. A draft is open to replies for ``days``, then it is abandoned.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.drafts = handle.getMapState("drafts", "draft_id string", "us long")
        self.replies = handle.getMapState("replies", "message_id string", "us long")
        self.settled = handle.getValueState("settled", "us long")

    def wake(self, us: int) -> None:
        """A timer for when the watermark, which counts in milliseconds, has passed ``us``."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for events in rows:
            times = events["event_ts"].astype("datetime64[us]").astype("int64").tolist()
            for us, draft_id, message_id in zip(times, events["draft_id"].tolist(), events["message_id"].tolist(), strict=True):
                if draft_id is None:
                    self.replies.updateValue((message_id,), (us,))
                    self.wake(us)
                else:
                    self.drafts.updateValue((draft_id,), (us,))
                    self.wake(us + self.days * DAY_US)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        if self.settled.exists() and self.settled.get()[0] >= upto:
            return  # a timer before this one has settled all
        self.settled.update((upto,))
        drafts = [(us, d) for (d,), (us,) in self.drafts.iterator() if us <= upto]
        replies = [(us, m) for (m,), (us,) in self.replies.iterator() if us <= upto]
        done, rest = settle(drafts, replies, upto, self.days)
        for _, message_id in replies:
            self.replies.removeKey((message_id,))
        for draft_id, *_ in done:
            self.drafts.removeKey((draft_id,))
        if not rest and not self.drafts.exists() and not self.replies.exists():
            self.settled.clear()
        if done:
            yield _rows([(key[0], *row) for row in done])

    def close(self) -> None:
        pass

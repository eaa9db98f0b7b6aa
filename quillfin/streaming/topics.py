"""Topics of page streams: pages arrive per file in order, chunks leave when they close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillfin.models.topics import OpenTopics

CLOSED = "path string, topic_id string, title string, summary string, page_refs array<int>, hero_page int"
_STATE = "ids array<string>, titles array<string>, summaries array<string>, pages array<array<int>>, heroes array<int>, newest int"


def closed_topics(pages: DataFrame, cold_pages: int = 20, max_pages: int = 15, idle: str | None = None) -> DataFrame:
    """Chunks of a stream of ``path, page, ord, topic_id, title, summary`` rows (one-page windows).

    State per file is its open topics only, each capped at ``max_pages`` pages and dropped once cold,
    so a file of any length keeps a bounded state. A row with a null topic marks the end of its file
    and closes what is open; with ``idle`` (such as "30 minutes") so does silence.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        open_topics = {}
        if held:
            ids, titles, summaries, seen, heroes, _ = held
            open_topics = {i: [t, s, list(p), h] for i, t, s, p, h in zip(ids, titles, summaries, seen, heroes)}
        tracker = OpenTopics(cold_pages, max_pages, open_topics)
        newest = held[5] if held else 0
        if state.hasTimedOut:
            state.remove()
            yield _frame(key[0], tracker.finish())
            return
        parts = list(frames)
        rows = pd.concat(parts).sort_values(["page", "ord"]) if parts else pd.DataFrame()
        ended = False
        for page, window in rows.groupby("page", sort=True):
            newest = max(newest, int(page))
            real = window[window["topic_id"].notna()]
            ended = ended or len(real) < len(window)
            tracker.window(list(zip(real["page"].astype(int), real["topic_id"], real["title"], real["summary"])), newest)
        closed = tracker.finish() if ended else tracker.closed
        if ended:
            state.remove()
        else:
            kept = tracker.open
            state.update(
                (
                    list(kept),
                    [t[0] for t in kept.values()],
                    [t[1] for t in kept.values()],
                    [[int(p) for p in t[2]] for t in kept.values()],
                    [int(t[3]) for t in kept.values()],
                    newest,
                )
            )
            if idle:
                state.setTimeoutDuration(idle)
        yield _frame(key[0], closed)

    return pages.groupBy("path").applyInPandasWithState(fold, CLOSED, _STATE, "append", timeout)


def _frame(path: str, closed: list) -> pd.DataFrame:
    rows = [
        (path, topic, title, summary, sorted(int(p) for p in pages), int(hero))
        for topic, (title, summary, pages, hero) in closed
    ]
    return pd.DataFrame(rows, columns=["path", "topic_id", "title", "summary", "page_refs", "hero_page"])

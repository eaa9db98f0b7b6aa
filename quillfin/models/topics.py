"""Topic models: prompts in, JSON replies out, asked inside Spark tasks.

A model is any picklable object with ``generate(prompt, images) -> str``. It should load lazily and
sample at temperature 0. ``OutlineModel`` is the offline default and is rule-based: every so many
lines of a text, or each page, is one topic named after its first line of text.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfin.functions.jsonx import repaired
from quillfin.functions.text import numbered_lines
from quillfin.models.limits import Expired, within

ATTEMPTS = 3
RETRY = "The last answer could not be read. Answer with the JSON alone.\n\n"


class TopicModel(Protocol):
    def generate(self, prompt: str, images: list[bytes]) -> str: ...


class OutlineModel:
    def __init__(self, lines_per_topic: int = 40) -> None:
        self.lines_per_topic = lines_per_topic

    def generate(self, prompt: str, images: list[bytes]) -> str:
        body = prompt.split("---\n", 1)[-1]
        pages = re.findall(r"(?m)^\[page (\d+)\]\n([^\n]*)", body)
        if pages:
            listed = [
                {"page": int(n), "topics": [{"id": f"page{n}", "is_continuation": False, "title": first.strip()[:80], "summary": ""}]}
                for n, first in pages
            ]
            return json.dumps({"pages": listed})
        lines = body.split("\n")
        topics = []
        for at in range(0, len(lines), self.lines_per_topic):
            part = [x[8:].strip(" #\t") for x in lines[at : at + self.lines_per_topic]]
            named = next((x for x in part if x), "")
            if named:
                topics.append({"title": f"{named[:80]} ({at + 1})", "summary": "", "ranges": [[at + 1, at + len(part)]]})
        return json.dumps(topics)


def text_prompt(window: Column, language: Column) -> Column:
    return F.concat(
        F.lit("Divide this "), language,
        F.lit(
            ' into topics. Answer with a JSON array of {"title", "summary", "ranges": [[first line, last line]]}. '
            "Topics may overlap or be made of several ranges.\n---\n"
        ),
        numbered_lines(window),
    )


def page_prompt(pages: list[tuple[int, str]], running: dict[str, str], max_topics: int) -> str:
    open_topics = json.dumps(running, ensure_ascii=False)
    texts = "\n".join(f"[page {n}]\n{text}" for n, text in pages)
    return (
        'Say which topics each page covers. Answer with JSON {"pages": [{"page", "topics": [{"id", "is_continuation", '
        f'"title", "summary"}}]}}]}}. At most {max_topics} new topics. Topics open so far: {open_topics}\n---\n{texts}'
    )


def found_value(reply: str | None, opener: str):
    """The JSON object or array in a reply, repaired if need be; null if there is none."""
    closer = "}" if opener == "{" else "]"
    block = re.search(re.escape(opener) + ".*" + re.escape(closer), reply or "", re.DOTALL)
    text = repaired(block.group(0)) if block else None
    return None if text is None else json.loads(text)


def page_topics(reply: str | None, pages: list[int], max_topics: int) -> list[tuple[int, str, bool, str, str]]:
    """``(page, id, is_continuation, title, summary)`` of a reply about these pages, entry by entry: the
    rules of ``functions.jsonx.parse_page_topics``, for the loop that needs each reply before the next."""
    doc = found_value(reply, "{")
    if not isinstance(doc, dict):
        return []
    listed = doc.get("pages")
    if len(pages) == 1 and not isinstance(listed, list):
        listed = [{"page": pages[0], "topics": doc.get("topics")}]
    rows, new = [], []
    for entry in listed if isinstance(listed, list) else []:
        page, said = (entry.get("page"), entry.get("topics")) if isinstance(entry, dict) else (None, None)
        if type(page) is not int or page not in pages or not isinstance(said, list):
            continue
        for t in said:
            if not isinstance(t, dict) or not isinstance(t.get("id"), str) or not t["id"]:
                continue
            carried = bool(t.get("is_continuation", t.get("c")))
            title, summary = (_label(t.get(long, t.get(brief))) for long, brief in (("title", "t"), ("summary", "s")))
            if not carried and title and title not in new:
                if len(new) >= max_topics:
                    continue
                new.append(title)
            rows.append((page, t["id"], carried, title, summary))
    return rows


def unparsed_title(first: int, last: int) -> str:
    return f"Unparsed window (pages {first}–{last})"


def _label(value) -> str:
    if isinstance(value, bool):
        return "true" if value else ""
    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", str(value)) if value and isinstance(value, (str, int, float)) else ""


def ask(model: TopicModel, prompt: str, images: list[bytes], opener: str, deadline: float | None = None, timeout: float | None = None) -> str | None:
    """A reply that holds JSON, within three attempts and before the deadline; else null. The deadline, or
    ``timeout`` seconds, ends a call that hangs; a model that has hung is not asked again."""
    for attempt in range(ATTEMPTS):
        left = deadline - time.time() if deadline is not None else None
        if left is not None and left <= 0:
            return None
        try:
            reply = within(lambda: model.generate(RETRY + prompt if attempt else prompt, images), min((t for t in (left, timeout) if t is not None), default=None))
            if found_value(reply, opener) is not None:
                return reply
        except Expired:
            return None
        except Exception:  # noqa: BLE001 - a failing model is a missing reply, reported as a skip
            continue
    return None


def text_replies(windows: DataFrame, model: TopicModel, deadline: float | None = None, timeout: float | None = None) -> DataFrame:
    """Replace ``prompt`` by ``reply``; one model call per row, where the row lies. Behind the deadline the
    model is no longer called, and ``late`` says so."""
    keep = [c for c in windows.columns if c != "prompt"]
    schema = T.StructType([windows.schema[c] for c in keep] + [T.StructField("reply", T.StringType()), T.StructField("late", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, late = [], []
            for prompt in batch.column("prompt").to_pylist():
                replies.append(ask(model, prompt, [], "[", deadline, timeout))
                late.append(replies[-1] is None and deadline is not None and time.time() > deadline)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(replies, pa.string()), pa.array(late)], names=[*keep, "reply", "late"]
            )

    return windows.mapInArrow(run, schema)


class OpenTopics:
    """Topics a file has open, with the closing rules: page cap first, then cold topics."""

    def __init__(self, cold_pages: int, max_pages: int, open_: dict[str, list] | None = None) -> None:
        self.cold_pages, self.max_pages = cold_pages, max_pages
        self.open: dict[str, list] = open_ or {}  # id -> [title, summary, pages, hero]
        self.closed: list[tuple[str, list]] = []

    def running(self) -> dict[str, str]:
        return {i: t[0] for i, t in self.open.items()}

    def window(self, assignments: list[tuple[int, str, str, str]], newest: int) -> None:
        """Apply one window's ``(page, id, title, summary)`` rows and close what is due."""
        for page, topic, title, summary in assignments:
            held = self.open.setdefault(topic, [title or f"Topic starting on p.{page}", summary, [], page])
            if page not in held[2]:
                held[2].append(page)
        full = [i for i, t in self.open.items() if len(t[2]) >= self.max_pages]
        cold = [i for i, t in self.open.items() if i not in full and newest - max(t[2]) >= self.cold_pages]
        self.closed += [(i, self.open.pop(i)) for i in full + cold]

    def finish(self) -> list[tuple[str, list]]:
        done, self.closed, self.open = self.closed + list(self.open.items()), [], {}
        return done

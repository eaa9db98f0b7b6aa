"""Pages of PDF files through a pluggable reader.

A reader is any picklable object with ``pages(content) -> iterator of (page, text, image bytes or
None)``, and optionally ``ocr(image) -> text``. No reader ships with the package; without one PDF
files are skipped with a reason.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from itertools import islice
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from quillfin.models.topics import OpenTopics, TopicModel, ask, page_prompt, page_topics, unparsed_title
from quillfin.settings import Settings

PAGE = "path string, page int, page_text string, image binary"
REPLY = "path string, window_no int, pages array<int>, reply string, late boolean"


class PdfReader(Protocol):
    def pages(self, content: bytes) -> Iterator[tuple[int, str, bytes | None]]: ...


def _read(reader: PdfReader, content: bytes, ocr_threshold: int) -> Iterator[tuple[int, str, bytes | None]]:
    """Pages with OCR where the native text is too short; an encrypted or broken file has none."""
    try:
        for page, text, image in reader.pages(content):
            if len(text.strip()) < ocr_threshold and image is not None and hasattr(reader, "ocr"):
                try:
                    text = reader.ocr(image) or text
                except Exception:  # noqa: BLE001 - failed OCR keeps the native text
                    pass
            yield page, text.strip(), image
    except Exception:  # noqa: BLE001 - a broken file yields what was readable
        return


def pdf_pages(files: DataFrame, reader: PdfReader, settings: Settings) -> DataFrame:
    """One row per page of ``(path, content)`` files."""
    threshold = settings.ocr_threshold

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                for page, text, image in _read(reader, content or b"", threshold):
                    yield pd.DataFrame([(path, page, text, image)], columns=["path", "page", "page_text", "image"])

    return files.select("path", "content").mapInPandas(run, PAGE)


def image_texts(images: DataFrame, reader) -> DataFrame:
    """Adds ``ocr_text`` to rows with ``content``; empty where the reader finds none or fails."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema), "ocr_text string"])

    def text(content: bytes | None) -> str:
        try:
            return (reader.ocr(content) or "").strip() if content else ""
        except Exception:  # noqa: BLE001 - one bad image must not lose the others
            return ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(ocr_text=[text(c) for c in frame["content"]])

    return images.mapInPandas(run, schema)


def pdf_replies(
    files: DataFrame, reader: PdfReader, model: TopicModel, settings: Settings, deadline: float | None = None
) -> DataFrame:
    """One row per page window with the model's reply.

    Each prompt names the topics still open, so the windows of a file are asked one after another
    while its pages stream by; files are independent. A file that is not done by the deadline ends with a
    row that says ``late``.
    """
    stride = settings.chunker_stride_pages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                state = OpenTopics(settings.chunker_topic_cold_pages, settings.chunker_topic_max_pages)
                pages = _read(reader, content or b"", settings.ocr_threshold)
                for number, window in enumerate(_windows(pages, stride)):
                    reply = _ask(model, settings, state, path, number, window, deadline)
                    yield reply
                    if reply["late"].iloc[0]:
                        break

    return files.select("path", "content").mapInPandas(run, REPLY)


def _windows(pages: Iterator, size: int) -> Iterator[list]:
    while window := list(islice(pages, size)):
        yield window


def _ask(model, settings, state: OpenTopics, path: str, number: int, window: list, deadline: float | None = None) -> pd.DataFrame:
    """The reply for one window; the open topics become what will be stored for it."""
    pages = [p for p, _, _ in window]
    limit = settings.chunker_max_topics_per_call
    prompt = page_prompt([(p, t) for p, t, _ in window], state.running(), limit)
    reply = ask(model, prompt, [i for _, _, i in window if i is not None], "{", deadline, settings.model_timeout)
    late = reply is None and deadline is not None and time.time() > deadline
    rows = [(p, t, title, summary) for p, t, _, title, summary in page_topics(reply, pages, limit)]
    rows = rows or [(p, f"unparsed_{number}", unparsed_title(min(pages), max(pages)), "") for p in pages]
    state.window(rows, pages[-1])
    return pd.DataFrame([(path, number, pages, reply, late)], columns=["path", "window_no", "pages", "reply", "late"])

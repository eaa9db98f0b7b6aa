"""Time limits that end work: one call inside a task, and a whole job from outside."""

from __future__ import annotations

import signal
import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")

# Seconds past its deadline that a job may take to end by itself, before it is ended.
GRACE = 30.0


class Expired(BaseException):
    """Not an ``Exception``, so that a model's own handlers let it through."""


def within(call: Callable[[], R], seconds: float | None) -> R:
    """The result of ``call``; ``Expired`` once ``seconds`` are over, also if it sleeps or waits for an answer.

    In a process's main thread, where tasks run, an alarm ends the call where it stands. Elsewhere it goes on
    in a thread that nobody waits for.
    """
    if seconds is None:
        return call()
    if seconds <= 0:
        raise Expired
    if threading.current_thread() is threading.main_thread():

        def expire(*_):
            raise Expired

        before = signal.signal(signal.SIGALRM, expire)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return call()
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    done: list = []

    def run():
        try:
            done.append((call(), None))
        except BaseException as exc:  # noqa: BLE001 - raised again where it is waited for
            done.append((None, exc))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise Expired
    value, failed = done[0]
    if failed is not None:
        raise failed
    return value


def until(spark: SparkSession, deadline: float, job: Callable[[], R], grace: float | None = None) -> R | None:
    """The result of ``job``, or ``None`` if its Spark jobs still ran ``grace`` seconds past the deadline and were ended.

    For what no alarm reaches, such as a model that hangs in native code: Spark ends the tasks and their workers.
    """
    tag, ended = f"until-{uuid.uuid4().hex}", threading.Event()

    def end() -> None:
        ended.set()
        spark.interruptTag(tag)

    left = deadline + (GRACE if grace is None else grace) - time.time()
    # A timer cannot wait for ever; what is that far off does not need one.
    timer = threading.Timer(max(left, 0.0), end) if left < threading.TIMEOUT_MAX else None
    spark.addTag(tag)
    if timer:
        timer.daemon = True
        timer.start()
    try:
        return job()
    except Exception:
        if ended.is_set():
            return None
        raise
    finally:
        if timer:
            timer.cancel()
        spark.removeTag(tag)

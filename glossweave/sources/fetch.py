"""Getting documents from mirrors. The transport is a function, so Spark jobs read landed files and tests need no network."""

from __future__ import annotations

import io
import os
import queue
import tarfile
import threading
import time
from collections.abc import Callable

from ..functions.text import TRANSIENT

Get = Callable[[str], object]


def expand(template: str, repo: str, branch: str) -> str:
    return template.strip().replace("{repo}", repo.strip()).replace("{branch}", branch.strip())


def distinct(urls: list[str]) -> list[str]:
    """Non-blank addresses, each once, in order."""
    return list(dict.fromkeys(u.strip() for u in urls if u.strip()))


def passing(error: Exception) -> bool:
    """Whether a failure may pass on its own."""
    return any(part in str(error) for part in TRANSIENT)


def first_good(get: Get, urls: list[str], delay: float = 2.0, again: float = 0.5):
    """The first answer of the mirrors, as soon as it is there. The next one is asked after `delay` or a failure; those whose failure may pass are asked once more.

    Mirrors are asked by daemon threads, so one that hangs holds up neither the answer nor the end of the program.
    """
    errors: list[Exception] = []
    again_of = list(urls)
    for turn in (0, 1):
        answers: queue.SimpleQueue = queue.SimpleQueue()

        def ask(url: str, answers=answers) -> None:
            try:
                answers.put((url, get(url), None))
            except Exception as e:  # any failure only means another mirror
                answers.put((url, None, e))

        todo, running, again_of = again_of, 0, []
        while todo or running:
            if todo:
                threading.Thread(target=ask, args=(todo.pop(0),), daemon=True).start()
                running += 1
            try:
                url, answer, error = answers.get(timeout=delay if todo else None)
            except queue.Empty:
                continue
            running -= 1
            if error is None:
                return answer
            errors.append(error)
            again_of += [url] if passing(error) else []
        if turn or not again_of:
            break
        time.sleep(again)
    raise RuntimeError("; ".join(map(str, errors)) or "no address")


def first_complete(get: Get, urls: list[str], complete: Callable[[object], bool], again: float = 0.5):
    """The first complete answer, one mirror after the other; those whose failure may pass are asked once more. The last incomplete answer if there is no other."""
    spare, errors, todo = [], [], list(urls)
    for turn in (0, 1):
        later = []
        for url in todo:
            try:
                answer = get(url)
            except Exception as e:  # any failure only means the next mirror
                errors.append(str(e))
                later += [url] if passing(e) else []
                continue
            if complete(answer):
                return answer
            spare = [answer]
        todo = later
        if turn or not todo:
            break
        time.sleep(again)
    if not spare:
        raise RuntimeError("; ".join(errors) or "no address")
    return spare[0]


#: Seconds that polling pauses after too many requests: where the answer doesn't say how long, at least and at most; and at most where it does.
PAUSE_LEAST, PAUSE_MOST, PAUSE_TOLD_MOST = 3600.0, 6 * 3600.0, 24 * 3600.0


def pause(told: str, now: float, interval: float) -> float:
    """Seconds to pause after too many requests: what the answer told, or else twice the polling interval, both held within bounds."""
    wait = retry_after(told, now)
    return min(wait, PAUSE_TOLD_MOST) if wait > 0 else min(max(2 * interval, PAUSE_LEAST), PAUSE_MOST)


#: Fixed value: the member of a version document that tells the version.
VERSION = "dataVersion"


class TooMany(RuntimeError):
    """Too many requests; `after` is the answer's Retry-After value."""

    def __init__(self, after: str = ""):
        super().__init__("http 429")
        self.after = after


class VersionPoll:
    """A version document that is asked for on condition that it changed.

    get(url, etag, modified) gives (body, etag, modified), body being None if nothing changed and else an object, or raises, TooMany
    among others. All mirrors are asked at once and the first answer holds. An object without a data version, and an answer that
    nothing changed where nothing is known, are failures of their mirror; only mirrors whose failure may pass are asked once more.
    """

    def __init__(self, get: Callable[[str, str, str], tuple], urls: list[str], interval: float = 3600.0):
        self.get, self.urls, self.interval, self.until = get, distinct(urls), interval, 0.0
        self._kept: dict[str, tuple] = {}

    def _ask(self, url: str):
        body, etag, modified = self.get(url, *self._kept.get(url, ("", "", None))[:2])
        if body is None:
            if url not in self._kept:
                raise ValueError(f"{url}: unchanged, but no version is known")
            body = self._kept[url][2]
        elif not (isinstance(body, dict) and body.get(VERSION)):
            raise ValueError(f"{url}: no {VERSION}")
        self._kept[url] = (etag, modified, body)
        return body

    def fetch(self, now: float):
        """The version document; RuntimeError while polling pauses, or if every mirror failed."""
        if now < self.until:
            raise RuntimeError(f"polling pauses for {self.until - now:.0f} s")
        self.until, paused = 0.0, []

        def ask(url: str):
            try:
                return self._ask(url)
            except TooMany as e:
                paused.append(e.after)
                raise

        try:
            return first_good(ask, self.urls, delay=0.0)
        except RuntimeError:
            if paused:
                self.until = now + pause(paused[0], now, self.interval)
            raise


def retry_after(value: str, now: float) -> float:
    """Seconds of a Retry-After value: a number, or a date; 0 for anything else or the past."""
    from email.utils import parsedate_to_datetime

    value = value.strip()
    if value.isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return 0.0


def pack(folder: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for top, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                tar.add(f"{top}/{name}", os.path.relpath(f"{top}/{name}", folder), recursive=False)
    return out.getvalue()


def unpack(data: bytes, folder: str) -> None:
    """Plain files of an archive; names that lead out of the folder are refused."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
        tar.extractall(folder, filter="data")

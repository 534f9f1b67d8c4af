"""GET requests of the REST sources: waits and repeats, size and redirect limits, pages of six styles."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

#: Bytes of an answer, repeats of a request, and seconds before each of them.
MAX_ANSWER, MAX_REPEATS, PAUSES, LONGEST_PAUSE = 64 << 20, 5, (1.0, 2.0, 5.0, 10.0), 60.0


class SourceFailure(Exception):
    """What a source answered that no repeat mends."""


class _Refuse(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def get(url: str, timeout: float = 30.0, repeats: int = MAX_REPEATS, sleep=time.sleep) -> tuple[object, str]:
    """(JSON answer, Link header). Busy and failing servers are asked again, after Retry-After where they say so.

    Redirects are refused, as they would take credentials elsewhere; an answer over MAX_ANSWER bytes is none.
    """
    where, opener = url.split("?")[0], urllib.request.build_opener(_Refuse)
    for attempt in range(repeats + 1):
        pause = PAUSES[min(attempt, len(PAUSES) - 1)]
        try:
            with opener.open(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
                body = answer.read(MAX_ANSWER + 1)
                if len(body) > MAX_ANSWER:
                    raise SourceFailure(f"{where}: answer over {MAX_ANSWER} bytes")
                try:
                    return json.loads(body), answer.headers.get("Link", "")
                except ValueError:
                    raise SourceFailure(f"{where}: not JSON") from None
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise SourceFailure(f"{where}: HTTP {e.code}") from None
            failure, pause = f"HTTP {e.code}", _pause(e.headers.get("Retry-After"), pause) if e.code in (429, 503) else pause
        except OSError as e:
            failure = type(e).__name__
        if attempt < repeats:
            sleep(pause)
    raise SourceFailure(f"{where}: {failure} after {repeats + 1} attempts")


def _pause(after: str | None, otherwise: float) -> float:
    try:
        seconds = float(after) if after.strip().isdigit() else parsedate_to_datetime(after).timestamp() - time.time()
    except (AttributeError, TypeError, ValueError):
        return otherwise
    return min(LONGEST_PAUSE, max(0.0, seconds))


def at(value: object, path: str) -> object:
    """What a dotted path leads to; None where it leads nowhere."""
    for name in filter(None, path.split(".")):
        value = value.get(name) if isinstance(value, dict) else None
    return value


class Pages:
    """The pages of a resource in one of six styles: none, page, offset, cursor, link, nextUrl.

    Options: paging, pagesize, at (dotted path of the records), next (field of the next cursor or address), timeout.
    """

    def __init__(self, options: dict[str, str], url: str):
        self.o, self.url = options, url
        self.style, self.size = options.get("paging", "none").lower(), int(options.get("pagesize", 100))

    def address(self, **params) -> str:
        parts = urllib.parse.urlsplit(self.url)
        query = dict(urllib.parse.parse_qsl(parts.query)) | {k: str(v) for k, v in params.items()}
        return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))

    def numbered(self, n: int, **params) -> str:
        own = {"page": n + 1, "per_page": self.size} if self.style == "page" else {"offset": n * self.size, "limit": self.size}
        return self.address(**params, **own)

    def follow(self, first: int = 0, step: int = 1, **params) -> Iterator[list]:
        """The records of each page up to the last: of numbered pages every step-th from `first` on."""
        n, url = first, self.numbered(first, **params) if self.style in ("page", "offset") else self.address(**params)
        while url:
            body, link = get(url, float(self.o.get("timeout", 30)), int(self.o.get("repeats", MAX_REPEATS)))
            found = at(body, self.o.get("at", ""))
            if not isinstance(found, list):
                raise SourceFailure(f"{self.url}: no list of records at {self.o.get('at', '')!r}")
            yield found
            n += step
            url = self._next(n, found, body, link, params)

    def _next(self, n: int, found: list, body: object, link: str, params: dict) -> str | None:
        if self.style in ("page", "offset"):
            return self.numbered(n, **params) if len(found) >= self.size else None
        if self.style == "cursor":
            token = at(body, self.o.get("next", "next"))
            return self.address(**params, cursor=token) if token not in (None, "") and found else None
        if self.style == "nexturl":
            return self._same_host(at(body, self.o.get("next", "nextUrl")))
        if self.style == "link":
            m = re.search(r'<([^>]+)>\s*;\s*rel="?next"?', link)
            return self._same_host(m[1] if m else None)
        return None

    def _same_host(self, url: str | None) -> str | None:
        if url and urllib.parse.urlsplit(url)[:2] != urllib.parse.urlsplit(self.url)[:2]:
            raise SourceFailure(f"{self.url}: the next page is on another host")
        return url or None

"""Remote services as Python data sources: wiki pages by offset, tickets by token, drive files by type.

    spark.dataSource.register(WikiSource)
    spark.read.format("quarry_wiki").option("url", "https://host").option("since", "2024-01-01T00:00:00Z").load()

Requests are made in the tasks; nothing is collected. Filters on the time of change, the project and the type are handed to the service
(`register` switches Spark's filter push-down on). The wiki is a stream too: an offset is the time and id of the last change seen, and a batch is
what changed after one offset up to another, so a restarted stream neither loses nor repeats a change. A `url` without http is a folder of
kept answers (see recorded.py). Every request is tried again, with growing pauses, on status 429 and 5xx and on lost
connections. The option `token` is sent as a bearer token.
"""

from __future__ import annotations

import csv
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from . import recorded

DOCUMENT, SHEET, SLIDES = (f"application/vnd.google-apps.{kind}" for kind in ("document", "spreadsheet", "presentation"))
#: What a file of each type is exported as; other types are read as they are.
EXPORTS = {DOCUMENT: "text/plain", SHEET: "text/csv", SLIDES: "text/plain"}


def fetch(options: dict[str, str], path: str, **query: object) -> bytes:
    """The body of one answer; null parameters are left out."""
    if not options["url"].startswith("http"):
        return recorded.answer(options["url"].rstrip("/"), path, query)
    sent = urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})
    request = urllib.request.Request(f"{options['url'].rstrip('/')}/{path}?{sent}")
    if token := options.get("token"):
        request.add_header("Authorization", f"Bearer {token}")
    tries, pause = int(options.get("tries", 4)), float(options.get("pause", 0.5))
    for left in range(tries, 0, -1):
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", 60))) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if left == 1 or not (e.code == 429 or e.code >= 500):
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if left == 1:
                raise
        time.sleep(pause)
        pause *= 2
    raise AssertionError("unreachable")


def _time(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(UTC) if text else None


class _Stride(InputPartition):
    """Every `of`-th page of a list, from page `first`."""

    def __init__(self, first: int, of: int):
        self.first, self.of = first, of


#: A choice that leaves nothing.
NONE = "-"


def _stamp(time_: datetime) -> str:
    return time_.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class _Reader(DataSourceReader):
    #: Column -> option that takes the values which a filter asks for.
    choices: dict[str, str] = {}

    def __init__(self, options: dict[str, str]):
        # The options come as a mapping that does not travel to the tasks.
        self.options = dict(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """The time of change narrows `since`, equality and lists narrow the choices. Spark keeps all filters: a service may be coarser."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "updated" and isinstance(f, GreaterThan | GreaterThanOrEqual) and isinstance(f.value, datetime):
                self.options["since"] = max(self.options.get("since") or "", _stamp(f.value))
            elif column in self.choices and isinstance(f, EqualTo | In):
                asked = [str(v) for v in (f.value if isinstance(f, In) else [f.value])]
                given = [t.strip() for t in self.options.get(self.choices[column], "").split(",") if t.strip()]
                self.options[self.choices[column]] = ",".join(v for v in (given or asked) if v in asked) or NONE
            yield f


def _page(p: dict) -> tuple:
    return (int(p["id"]), p.get("title"), p.get("body"), p.get("space"), p.get("url"), list(p.get("labels") or []), _time(p.get("lastModified")))


class _Changes(InputPartition):
    def __init__(self, stride: _Stride, start: dict, end: dict):
        self.stride, self.start, self.end = stride, start, end


class _WikiStream(DataSourceStreamReader):
    """Changes in the order of (time, id); an offset is the last one seen."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.options.get("since") or "", "id": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        found = json.loads(fetch(self.options, "rest/api/content", newest=1, limit=1))["results"]
        return {"at": found[-1]["lastModified"], "id": int(found[-1]["id"])} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Changes]:
        of = int(self.options.get("readers", 4))
        return [_Changes(_Stride(i, of), start, end) for i in range(of)]

    def read(self, partition: _Changes) -> Iterator[tuple]:
        low, high = ((o["at"], o["id"]) for o in (partition.start, partition.end))
        size, number = int(self.options.get("pagesize", 50)), partition.stride.first
        while True:
            found = json.loads(fetch(self.options, "rest/api/content", start=number * size, limit=size, since=low[0] or None))["results"]
            own = [p for p in found if low < (p["lastModified"], int(p["id"])) <= high]
            yield from map(_page, own)
            if len(found) < size or (found[-1]["lastModified"], int(found[-1]["id"])) > high:
                return
            number += partition.stride.of

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class _WikiReader(_Reader):
    def partitions(self) -> list[_Stride]:
        of = int(self.options.get("readers", 4))
        return [_Stride(i, of) for i in range(of)]

    def read(self, partition: _Stride) -> Iterator[tuple]:
        size, number = int(self.options.get("pagesize", 50)), partition.first
        while True:
            found = json.loads(fetch(self.options, "rest/api/content", start=number * size, limit=size, since=self.options.get("since")))["results"]
            yield from map(_page, found)
            if len(found) < size:
                return
            number += partition.of


class WikiSource(DataSource):
    """Pages by offset, several readers in turn; `since` is handed to the service."""

    @classmethod
    def name(cls) -> str:
        return "quarry_wiki"

    def schema(self) -> str:
        return "page_id bigint, title string, content string, space string, url string, labels array<string>, updated timestamp"

    def reader(self, schema) -> _WikiReader:  # noqa: ANN001
        return _WikiReader(self.options)

    def streamReader(self, schema) -> _WikiStream:  # noqa: ANN001, N802
        return _WikiStream(self.options)


class _Project(InputPartition):
    def __init__(self, project: str):
        self.project = project


class _TicketReader(_Reader):
    choices = {"project": "projects"}

    def partitions(self) -> list[_Project]:
        return [_Project(p.strip()) for p in self.options["projects"].split(",")]

    def read(self, partition: _Project) -> Iterator[tuple]:
        token, left = None, 0 if partition.project == NONE else int(self.options.get("most", 1 << 62))
        while left > 0:
            answer = json.loads(fetch(self.options, "rest/api/search", project=partition.project, token=token, limit=min(left, int(self.options.get("pagesize", 100))), since=self.options.get("since")))
            for t in answer["issues"][:left]:
                yield (t["key"], partition.project, t.get("summary"), t.get("description"), t.get("status"), t.get("priority"), t.get("assignee"), _time(t.get("created")), _time(t.get("updated")), json.dumps(t, sort_keys=True))
            left -= len(answer["issues"])
            token = answer.get("nextPageToken")
            if not token or not answer["issues"]:
                return


class TicketSource(DataSource):
    """Tickets by token, one reader a project; `most` caps the tickets of a project."""

    @classmethod
    def name(cls) -> str:
        return "quarry_tickets"

    def schema(self) -> str:
        return "key string, project string, summary string, description string, status string, priority string, assignee string, created timestamp, updated timestamp, raw string"

    def reader(self, schema) -> _TicketReader:  # noqa: ANN001
        return _TicketReader(self.options)


class _Files(InputPartition):
    """A page of the list, by its token."""

    def __init__(self, token: str | None):
        self.token = token


class _DriveReader(_Reader):
    """The driver follows the tokens alone; each reader asks for its page of the list again, and for the files on it. So no list of files is in one
    place, and there are as many tasks as pages."""

    choices = {"type": "types"}

    def _types(self) -> list[str]:
        return [t.strip() for t in self.options.get("types", "").split(",") if t.strip()]

    def _list(self, token: str | None, fields: str | None = None) -> dict:
        wanted = " or ".join(f"mimeType='{t}'" for t in self._types()) or None
        return json.loads(fetch(self.options, "files", q=wanted, pageToken=token, pageSize=int(self.options.get("filesperreader", 1000)), fields=fields))

    def partitions(self) -> list[_Files]:
        out = [_Files(None)]
        while self._types() != [NONE] and (token := self._list(out[-1].token, "nextPageToken").get("nextPageToken")):
            out.append(_Files(token))
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        types = self._types()
        for f in [] if types == [NONE] else self._list(partition.token)["files"]:
            kind = f["mimeType"]
            if types and kind not in types:
                continue
            path, as_ = (f"files/{f['id']}/export", EXPORTS[kind]) if kind in EXPORTS else (f"files/{f['id']}", None)
            raw = fetch(self.options, path, mimeType=as_, alt=None if as_ else "media").decode("utf-8", "replace")
            yield (f["id"], f.get("name"), kind, markdown_of_csv(raw) if kind == SHEET else raw, _time(f.get("modifiedTime")))


class DriveSource(DataSource):
    """Files of the types asked for, exported as text; sheets as markdown tables. `filesperreader`: files on a page of the list, which one reader takes."""

    @classmethod
    def name(cls) -> str:
        return "quarry_drive"

    def schema(self) -> str:
        return "id string, name string, type string, content string, updated timestamp"

    def reader(self, schema) -> _DriveReader:  # noqa: ANN001
        return _DriveReader(self.options)


def markdown_of_csv(text: str) -> str:
    """A markdown table: the first row that is not blank is the header, blank rows go, pipes are escaped, short rows are filled up."""
    rows = [[c.strip().replace("|", "\\|") for c in r] for r in csv.reader(io.StringIO(text))]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join(lines[:1] + (["|" + " --- |" * width] if lines else []) + lines[1:])


def register(spark) -> None:  # noqa: ANN001
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WikiSource, TicketSource, DriveSource):
        spark.dataSource.register(source)

"""REST endpoints that return JSON records, as a data source, and that take them, as a sink.

Options: url, records (dotted path to the records), paginate (none, offset, page, cursor, link), page_size, the parameters' names
(offset_param, limit_param, page_param, cursor_param, cursor_path), total_path (makes offset and page pagination one partition a page),
auth (none, bearer, basic, api_key, oauth2) with token, user, password, key_header, key, token_url, client_id, client_secret;
filters (column=parameter, ...: a comparison by this operator, one of = < <= > >=, is sent as the parameter's value, so
"id=id,age>=min_age,age<max_age"), rate (requests a second), retries, max_records; flatten (true: objects become columns with dotted names,
down to `depth`, 3, levels). Columns are strings, numbers and booleans by the first value that isn't null; other nested values are JSON strings.

Writing: append sends POST, overwrite PUT (method says otherwise), batch_size (100) records a request as a JSON list, or one by one as
objects if it is 1; under `records`, a dotted path, if given; unflatten (true) makes objects of dotted names. Requests are tried again
like reads, so a server may see a batch twice if its answer was lost, or if a task is run again.
"""

from __future__ import annotations

import base64
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

OPERATORS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}


def dig(value: Any, path: str | None) -> Any:
    for part in (path or "").split("."):
        if part:
            value = value.get(part) if isinstance(value, dict) else None
    return value


class Client:
    def __init__(self, options: dict[str, str]):
        self.o, self.last, self.bearer = options, 0.0, None

    def headers(self) -> dict[str, str]:
        o, kind = self.o, self.o.get("auth", "none")
        if kind == "bearer":
            return {"Authorization": f"Bearer {o['token']}"}
        if kind == "basic":
            return {"Authorization": "Basic " + base64.b64encode(f"{o['user']}:{o['password']}".encode()).decode()}
        if kind == "api_key":
            return {o.get("key_header", "X-API-Key"): o["key"]}
        if kind == "oauth2":
            if self.bearer is None:
                data = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": o["client_id"], "client_secret": o["client_secret"]}).encode()
                with urllib.request.urlopen(urllib.request.Request(o["token_url"], data=data), timeout=30) as r:
                    self.bearer = json.loads(r.read())["access_token"]
            return {"Authorization": f"Bearer {self.bearer}"}
        return {}

    def get(self, url: str, params: dict[str, Any]) -> tuple[Any, dict[str, str]]:
        if params:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
        return self.send(url)

    def send(self, url: str, method: str = "GET", body: Any = None) -> tuple[Any, dict[str, str]]:
        data = None if body is None else json.dumps(body).encode()
        extra = {} if data is None else {"Content-Type": "application/json"}
        tries = int(self.o.get("retries", "4"))
        for k in range(tries + 1):
            if rate := float(self.o.get("rate", "0")):
                time.sleep(max(0.0, self.last + 1 / rate - time.time()))
            self.last = time.time()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, data=data, method=method, headers=self.headers() | extra), timeout=60) as r:
                    text = r.read()
                    return json.loads(text) if text or data is None else None, {a.lower(): b for a, b in r.headers.items()}
            except urllib.error.HTTPError as e:
                if k == tries or e.code != 429 and e.code < 500:
                    raise
                wait = e.headers.get("Retry-After")
                time.sleep(float(wait) if wait and wait.isdigit() else 0.2 * 2**k)
        raise RuntimeError("unreachable")


def pages(o: dict[str, str], params: dict[str, Any], first: int = 0, only: bool = False) -> Iterator[list[dict]]:
    """Pages of records from page number `first` on, or that page only."""
    client, how, size, url = Client(o), o.get("paginate", "none"), int(o.get("page_size", "100")), o["url"]
    k, cursor = first, None
    while True:
        p = dict(params)
        if how == "offset":
            p |= {o.get("offset_param", "offset"): k * size, o.get("limit_param", "limit"): size}
        elif how == "page":
            p |= {o.get("page_param", "page"): k + int(o.get("first_page", "1")), o.get("limit_param", "per_page"): size}
        elif how == "cursor" and cursor is not None:
            p[o.get("cursor_param", "cursor")] = cursor
        body, headers = client.get(url, p)
        found = dig(body, o.get("records"))
        found = found if isinstance(found, list) else [found] if found else []
        yield found
        k += 1
        if only or how == "none" or how in ("offset", "page") and len(found) < size:
            return
        if how == "cursor":
            cursor = dig(body, o.get("cursor_path", "next"))
            if not cursor:
                return
        if how == "link":
            nxt = [x.split(";")[0].strip(" <>") for x in headers.get("link", "").split(",") if 'rel="next"' in x]
            if not nxt:
                return
            url, params = urllib.parse.urljoin(url, nxt[0]), {}


def flat(record: dict, depth: int, prefix: str = "") -> dict[str, Any]:
    """Objects as dotted names, down to a depth."""
    out: dict[str, Any] = {}
    for k, v in record.items():
        out |= flat(v, depth - 1, f"{prefix}{k}.") if isinstance(v, dict) and depth > 1 else {f"{prefix}{k}": v}
    return out


def nested(record: dict[str, Any]) -> dict[str, Any]:
    """Dotted names as objects."""
    out: dict[str, Any] = {}
    for name, v in record.items():
        at, *rest = name.split(".")
        here = out
        for part in rest:
            here = here.setdefault(at, {})
            at = part
        here[at] = v
    return out


def shaped(found: list[dict], o: dict[str, str]) -> list[dict]:
    return [flat(r, int(o.get("depth", "3"))) for r in found] if o.get("flatten", "").lower() == "true" else found


def kind_of(values: list[Any]) -> str:
    v = next((v for v in values if v is not None), None)
    return "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"


class Page(InputPartition):
    def __init__(self, number: int, only: bool):
        self.number, self.only = number, only


class RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.o, self.schema, self.params = options, schema, {}
        found = [re.fullmatch(r"\s*(.+?)\s*(<=|>=|=|<|>)\s*(\S+)\s*", x) for x in options.get("filters", "").split(",")]
        self.allowed = {(m[1], m[2]): m[3] for m in found if m}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            key = (".".join(f.attribute), OPERATORS[type(f)]) if type(f) in OPERATORS else None
            if key in self.allowed and self.allowed[key] not in self.params:
                self.params[self.allowed[key]] = f.value.isoformat() if hasattr(f.value, "isoformat") else f.value
            yield f  # the server's reading of it may differ, so Spark filters again

    def partitions(self) -> list[Page]:
        if self.o.get("paginate") in ("offset", "page") and (path := self.o.get("total_path")):
            size = int(self.o.get("page_size", "100"))
            body, _ = Client(self.o).get(self.o["url"], self.params | {self.o.get("limit_param", "limit" if self.o["paginate"] == "offset" else "per_page"): 1})
            return [Page(k, True) for k in range(-(-int(dig(body, path) or 0) // size))] or [Page(0, True)]
        return [Page(0, False)]

    def read(self, partition: Page) -> Iterator[tuple]:
        most, n = int(self.o.get("max_records", "0")), 0
        for found in pages(self.o, self.params, partition.number, partition.only):
            for record in shaped(found, self.o):
                yield tuple(self._value(dig(record, f.name) if f.name not in record else record[f.name], f.dataType.simpleString()) for f in self.schema.fields)
                n += 1
                if most and n >= most:
                    return

    @staticmethod
    def _value(v: Any, kind: str) -> Any:
        if v is None:
            return None
        if kind == "string":
            return v if isinstance(v, str) else json.dumps(v)
        return float(v) if kind == "double" else v


class Rest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        sample = shaped(next(pages(dict(self.options), {}), []), dict(self.options))
        names = list(dict.fromkeys(k for r in sample for k in r))
        return ", ".join(f"`{n}` {kind_of([r.get(n) for r in sample])}" for n in names)

    def reader(self, schema) -> RestReader:
        return RestReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> RestWriter:
        return RestWriter(dict(self.options), schema, overwrite)


class Sent(WriterCommitMessage):
    pass


class RestWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema, overwrite: bool):
        self.o, self.names = options, schema.fieldNames()
        self.method = options.get("method", "PUT" if overwrite else "POST").upper()

    def write(self, rows: Iterator) -> WriterCommitMessage:
        client, size, batch = Client(self.o), int(self.o.get("batch_size", "100")), []

        def send() -> None:
            body: Any = batch[0] if size == 1 else batch
            for part in reversed([p for p in self.o.get("records", "").split(".") if p]):
                body = {part: body}
            client.send(self.o["url"], self.method, body)

        for row in rows:
            record = {n: plain(v) for n, v in zip(self.names, row, strict=True)}
            batch.append(nested(record) if self.o.get("unflatten", "").lower() == "true" else record)
            if len(batch) == size:
                send()
                batch = []
        if batch:
            send()
        return Sent()


def plain(v: Any) -> Any:
    """A value as JSON has it."""
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else v if v is None or isinstance(v, (bool, int, float, str)) else str(v)

"""Chat endpoints that answer by the paper's number, for queries and tests: each kind of refusal and answer is one remainder."""

from __future__ import annotations

import json
import re

#: Remainders of the paper's number.
KINDS = 12


def _number(request: dict) -> int:
    return int(re.search(r"paper (\d+)", request["messages"][-1]["content"])[1])


def body(content: str, thought: str = "") -> str:
    return json.dumps({"choices": [{"message": {"content": content, "reasoning_content": thought}, "finish_reason": "stop"}]})


def content_of(n: int) -> str:
    finding = {"page": n % 5 + 1, "span_index": n % 3, "keep": n % 2 == 0, "aspect": "method", "confidence": 2, "citation_text": "see [3, 4]"}
    good = json.dumps({"findings": [finding, {"page": str(n % 5 + 1), "span_index": 7.0, "keep": "yes", "stance": "odd"}]})
    return {
        5: "", 6: "no JSON here", 7: "[1, 2]", 8: '{"findings": "x"}', 9: '{"findings": [{"page": true, "span_index": 1}]}', 10: f"<think>{{}}</think> so:\n```json\n{good}\n```", 11: f'first {{"a": 1}} then {good} and {{"b": 2}}',
    }.get(n % KINDS, good)


def answering(request: dict) -> tuple[int, str]:
    """Refuses options, fails, or answers with JSON in one form or another."""
    n = _number(request)
    if n % KINDS == 0 and "response_format" in request or n % KINDS == 1 and ("response_format" in request or "chat_template_kwargs" in request):
        return 400, "unknown option"
    if n % KINDS == 2:
        return 500, "boom"
    if n % KINDS == 3:
        raise ConnectionError("Connection refused")
    if n % KINDS == 4:
        return 400, "maximum context length is 8192"
    return 200, body(content_of(n), "hm" if n % KINDS == 5 else "")


def writing(request: dict) -> tuple[int, str]:
    """Writes plain text, in its thoughts only now and then, or fails."""
    n = _number(request)
    if n % KINDS == 2:
        return 500, "boom"
    return 200, body("" if n % KINDS in (5, 6) else f"It cites paper {n}.", "" if n % KINDS == 6 else f"I think of paper {n}.")


class TableService:
    """A remote service over the rows of a Parquet table: pages by offset or by cursor, in the order of the files.

    ``path`` must be one that the tasks can open; a real service would be called over the network.
    """

    def __init__(self, path: str, columns: list[str], page_rows: int = 100):
        self.path, self.columns, self.page_rows = path, columns, page_rows

    def _table(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path.removeprefix("file:"))

    def rows(self) -> int:
        return self._table().count_rows()

    def page(self, offset: int, count: int) -> list[tuple]:
        total = self.rows()
        found = self._table().take(list(range(min(offset, total), min(offset + count, total))), columns=self.columns)
        return list(zip(*(found.column(c).to_pylist() for c in self.columns), strict=True))

    def at(self, cursor: str) -> list[tuple]:
        return self.page(0 if cursor == "*" else int(cursor[1:]), self.page_rows)

    def following(self, cursor: str) -> str | None:
        after = (0 if cursor == "*" else int(cursor[1:])) + self.page_rows
        return f"c{after}" if after < self.rows() else None


def late_failure(service: TableService, good_rows: int):
    """The service's pages, of which all from ``good_rows`` on are out of reach."""

    def page(offset: int, count: int) -> list[tuple]:
        if offset >= good_rows:
            raise RuntimeError("unreachable")
        return [(None, "partial")] * count

    return page


def fetching(url: str) -> tuple[int, str]:
    """A page about the URL itself; every fifth is missing, every seventh out of reach."""
    k = sum(url.encode())
    if k % 5 == 0:
        return 404, "not here"
    if k % 7 == 0:
        raise TimeoutError("timed out")
    return 200, f"page of {url}"

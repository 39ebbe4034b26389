"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from possum.llm.common import ship

ALLOW, BLOCK = "allow", "block"
_LOWER = {c: c + 32 for c in range(65, 91)}
# The broadcast trie is built from a list in the program; larger lists are refused.
MAX_RULE_CHARS = 64 << 20


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lowered; path up to ``? #``. Else two empty strings."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


class _Node:
    __slots__ = ("down", "paths")

    def __init__(self):
        self.down: dict[str, _Node] = {}  # next host label, or next path segment
        self.paths: dict | None = None  # host node: root of its path trie; path node: last-segment prefixes


class UrlTrie:
    """Allow and block entries ``(verdict, host, path)``.

    A host entry covers the host and its subdomains; a path entry covers the
    paths that start with it (empty: ``/``). The match with most host labels
    wins, then the longest path; of an allow and a block entry for the same
    place the block entry wins.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        if sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_CHARS:
            raise ValueError(f"rules exceed {MAX_RULE_CHARS} characters, the bound of the broadcast trie")
        self.root = _Node()
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, path = host.translate(_LOWER), path or "/"
            node = self.root
            for label in reversed(host.split(".")):
                node = node.down.setdefault(label, _Node())
            node.paths = node.paths or {"": _Node()}
            here = node.paths[""]
            *whole, tail = path[1:].split("/")
            for seg in whole:
                here = here.down.setdefault(seg, _Node())
            here.paths = here.paths if here.paths is not None else {}
            if here.paths.get(tail, ("", ALLOW))[1] != BLOCK:
                here.paths[tail] = (host + path, verdict)

    def _path_match(self, node: _Node, segs: list[str]) -> tuple[str, str] | None:
        best = None
        for seg in segs:
            if node.paths:
                tail = next((seg[:n] for n in range(len(seg), -1, -1) if seg[:n] in node.paths), None)
                best = node.paths[tail] if tail is not None else best
            node = node.down.get(seg)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        if not host or not path:
            return None
        node, best, segs = self.root, None, path[1:].split("/")
        for label in reversed(host.split(".")):
            node = node.down.get(label)
            if node is None:
                break
            if node.paths:
                best = self._path_match(node.paths[""], segs) or best
        return best


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A null url or one without ``://`` has an empty host and path and the
    default verdict; repeated rows are judged each; other columns are ignored;
    an empty table gives an empty result. No shuffle.
    """
    ship(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [trie.value.match(h, p) for h, p in parts]
            yield pa.record_batch(
                [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                 pa.array([m and m[0] for m in found], pa.string()), pa.array([m[1] if m else default for m in found], pa.string())],
                schema=schema,
            )

    cols = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return cols.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")

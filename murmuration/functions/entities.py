"""Matching of names in texts, and walks through JSON of any shape."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def name_variants(name: str) -> list[str]:
    """Lower-case forms under which a person is written: whole name, first and last, last alone if it is long."""
    parts = name.lower().split()
    out = [" ".join(parts)]
    if len(parts) > 1:
        out += [f"{parts[0]} {parts[-1]}"] + ([parts[-1]] if len(parts[-1]) > 4 else [])
    return list(dict.fromkeys(p for p in out if p))


def match_confidence(text: Column, keywords: list[str]) -> Column:
    """The surest keyword in the text: 1.0 for three words and more, 0.8 for two, 0.7 for a long word, 0.5 for a short one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sure = lambda k: 1.0 if len(k.split()) >= 3 else 0.8 if len(k.split()) == 2 else 0.7 if len(k) > 4 else 0.5
    return F.greatest(*[F.when(F.contains(low, F.lit(k)), sure(k)).otherwise(0.0) for k in keywords], F.lit(0.0))


def adaptive_filter(rows: DataFrame, keywords: list[str], text: str = "text", strict: float = 0.7, relaxed: float = 0.5, enough: int = 10) -> DataFrame:
    """Rows that match strictly, or less strictly where fewer than `enough` do."""
    m = rows.withColumn("confidence", match_confidence(F.col(text), keywords))
    bar = strict if m.filter(F.col("confidence") >= strict).limit(enough).count() >= enough else relaxed
    return m.filter(F.col("confidence") >= bar)


def or_keywords(query: str) -> list[str]:
    """The phrase, its pairs of longer words, and these words."""
    words = [w for w in query.lower().split() if len(w) > 3]
    return list(dict.fromkeys([query.lower().strip(), *(" ".join(p) for p in zip(words, words[1:], strict=False)), *words]))


#: Paths below any object that hold counts, by what they count (fixed values, in order).
COUNT_KEYS = {
    "reactions": [("reaction_count", "count"), ("cross_universe_feedback_info", "aggregated_reaction_count")],
    "comments": [("comments", "total_count"), ("cross_universe_feedback_info", "aggregated_comment_count")],
    "shares": [("share_count", "count")],
}


#: What the address of a post contains.
POST_URL = re.compile(r"/posts/|/videos/|/photos?/|/permalink|story_fbid|/reel/")


def objects(node, depth: int, stop=lambda d: False) -> Iterator[dict]:
    """All objects of a JSON value down to a depth, in order; those that `stop` takes are not entered. One branch is held at
    a time."""
    todo = [(node, 0)]
    while todo:
        x, d = todo.pop()
        if d > depth or not isinstance(x, (dict, list)):
            continue
        if isinstance(x, dict):
            yield x
            if stop(x):
                continue
        todo += [(v, d + 1) for v in reversed(list(x.values()) if isinstance(x, dict) else x)]


def _content(d: dict) -> bool:
    """Whether an object holds a post's text itself."""
    t = d.get("text")
    return isinstance(t, str) and len(t) > 20 and not t.startswith("http")


def deep_counts(rows: DataFrame, column: str, keep: list[str], depth: int = 20, text_depth: int = 15) -> DataFrame:
    """Largest reaction, comment and share counts anywhere in JSON texts, and the longest text of over 20 characters that
    is no address (none below an object that has one itself; of equal ones the first); bad JSON gives zeros. A kernel, as SQL has no walk of unknown depth; batches are bounded."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def number(d: dict, path: tuple[str, str]) -> int:
        inner = d.get(path[0])
        v = inner.get(path[1]) if isinstance(inner, dict) else None
        return v if isinstance(v, int) and not isinstance(v, bool) else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = {k: [] for k in (*COUNT_KEYS, "message")}
            for body in t[column]:
                try:
                    root = json.loads(body)
                except (TypeError, ValueError):
                    root = None
                most, message = dict.fromkeys(COUNT_KEYS, 0), None
                for d in objects(root, depth):
                    for kind, paths in COUNT_KEYS.items():
                        most[kind] = max(most[kind], *(number(d, p) for p in paths))
                for d in objects(root, text_depth, _content):
                    if _content(d) and (message is None or len(d["text"]) > len(message)):
                        message = d["text"]
                for kind in COUNT_KEYS:
                    out[kind].append(most[kind])
                out["message"].append(message)
            yield t[keep].assign(**out)

    return rows.select(*keep, column).mapInPandas(run, f"{schema}, reactions bigint, comments bigint, shares bigint, message string")


def fallback_stories(rows: DataFrame, column: str, keep: list[str], depth: int = 25) -> DataFrame:
    """(keep, url, created) of every object anywhere in JSON texts that has the address of a post and a positive time of
    creation in seconds; of one address the first of its row. Bad JSON gives none. Same kernel as `deep_counts`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            at, urls, times = [], [], []
            for k, body in enumerate(t[column]):
                try:
                    root = json.loads(body)
                except (TypeError, ValueError):
                    continue
                seen: set[str] = set()
                for d in objects(root, depth):
                    url, created = d.get("url"), d.get("creation_time")
                    if isinstance(url, str) and url not in seen and POST_URL.search(url) and isinstance(created, int) and not isinstance(created, bool) and created > 0:
                        seen.add(url)
                        at, urls, times = [*at, k], [*urls, url], [*times, created]
            yield t[keep].iloc[at].assign(url=urls, created=times)

    return rows.select(*keep, column).mapInPandas(run, f"{schema}, url string, created bigint")

"""Reconstruction of goal texts that line breaks cut: genuinely sequential, so one Arrow-batched Python function per batch.

Only documents whose goals break off reach it (callers filter first); each row
holds a document's lines and its goal fragments, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ENDS = re.compile(r"[.!?]$")
DANGLES = re.compile(r"\b(?:of|to|for|from|with)$", re.IGNORECASE)
GOES_ON = re.compile(r"^(?:and|the|to|for|that|which|it|this|these|those|in|on|by|of)\b", re.IGNORECASE)
HEADING = re.compile(r"^(?:[A-Z][A-Za-z]*:?|[A-Z ]{4,}|(?:Goal|Objective|Section|Table|Element)\b.*)$")
STARTER = re.compile(r"ultimate goal|overall goal|primary objective|the goal is|our goal is|the objective is|the goals are|our goals are|project goals?|program goals?", re.IGNORECASE)


def locate(lines: list[str], fragment: str, characters: int = 40) -> int:
    """The first line that has the fragment's start, or -1."""
    head = fragment[:characters].strip()
    return next((i for i, line in enumerate(lines) if head and head in line), -1)


def merged(lines: list[str], goal: str) -> str:
    """A goal that starts like one and does not end, with the lines behind it up to a mark or a blank: at most eight."""
    at = locate(lines, goal, 50) if STARTER.search(goal) and not ENDS.search(goal) else -1
    if at < 0:
        return goal
    text, added = lines[at].strip(), False
    for line in (x.strip() for x in lines[at + 1 : at + 9]):
        if ENDS.search(text) or not line:
            break
        if line[:1].isupper() and not GOES_ON.match(line) and added:
            break
        text, added = f"{text} {line}", True
    return text if added else goal


def extended(lines: list[str], goal: str) -> str:
    """A short goal that ends in a preposition, with up to three more lines while it still does."""
    at = locate(lines, goal[-40:])
    for line in lines[at + 1 : at + 4] if at >= 0 else ():
        if not DANGLES.search(goal) or len(goal.split()) >= 60 or not line.strip():
            break
        goal = f"{goal} {line.strip()}"
    return goal


def paragraph(lines: list[str], goal: str, most_words: int = 120) -> str | None:
    """The paragraph that starts with the goal's first six words: up to a blank, a heading or a runaway; None if hardly longer."""
    head = re.sub(r"[^\w\s]", "", " ".join(goal.split()[:6]))[:40]
    at = next((i for i, line in enumerate(lines) if head and head.lower() in re.sub(r"[^\w\s]", "", line).lower()), -1)
    if at < 0:
        return None
    text = lines[at].strip()
    for line in (x.strip() for x in lines[at + 1 : at + 13]):
        if not line or HEADING.match(line) or len(text.split()) > most_words:
            break
        text = f"{text} {line}"
    text = re.sub(r"\s+", " ", re.sub(r"([A-Za-z])-(\s+)([a-z])", r"\1\3", text)).strip()
    return text if len(text) > len(goal) + 20 else None


def reconstruct(goals: DataFrame) -> DataFrame:
    """goals: (doc_id, id, title, lines).  Adds full_title (merged and extended) and full_paragraph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            whole = [extended(list(x), merged(list(x), t)) for t, x in zip(frame["title"], frame["lines"], strict=True)]
            yield frame.drop(columns="lines").assign(full_title=whole, full_paragraph=[paragraph(list(x), t) for t, x in zip(whole, frame["lines"], strict=True)])

    kind = goals.schema["doc_id"].dataType.simpleString()
    return goals.select("doc_id", "id", "title", "lines").mapInPandas(run, f"doc_id {kind}, id string, title string, full_title string, full_paragraph string")

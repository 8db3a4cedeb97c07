"""Seams for what stays outside: recognition models, script conversion, font metrics. Fakes and identity defaults stand in for them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class OcrEngine(Protocol):
    def recognise(self, images: list[bytes]) -> list[dict]:
        """For each image rec_texts, rec_scores and rec_polys."""


class MarkdownEngine(Protocol):
    def to_markdown(self, content: bytes) -> str: ...


class ScriptConverter(Protocol):
    def convert(self, text: str) -> str: ...


class FontMetrics(Protocol):
    def advance(self, text: str) -> float: ...
    def has_glyph(self, char: str) -> bool: ...


class Identity:
    """Converts nothing; measures a text by its characters."""

    def convert(self, text: str) -> str:
        return text

    def advance(self, text: str) -> float:
        return float(len(text))

    def has_glyph(self, char: str) -> bool:
        return True


def recognise(pages: DataFrame, engine: OcrEngine, batch: int = 4) -> DataFrame:
    """doc_id, page_index, result (JSON) of images (doc_id, page_index, image), so many to a call. A call that fails is tried image by image; an image that fails has an empty result."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for rows in it:
            for a in range(0, len(rows), batch):
                part = rows.iloc[a : a + batch]
                images = list(part["image"])
                try:
                    got = engine.recognise(images)
                except Exception:
                    got = []
                    for x in images:
                        try:
                            got += engine.recognise([x])
                        except Exception:
                            got.append({})
                yield pd.DataFrame({"doc_id": part["doc_id"], "page_index": part["page_index"], "result": [json.dumps(g) for g in got]})

    return pages.select("doc_id", "page_index", "image").mapInPandas(run, "doc_id long, page_index int, result string")


def to_markdown(files: DataFrame, engine: MarkdownEngine) -> DataFrame:
    """path, markdown, error of files (path, content); a failure is a row's error and not the job's."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    out.append((path, engine.to_markdown(content), None))
                except Exception as e:
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")

"""Hooks for the caller's recognition engine and vision model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OCR_RAW = "image_id bigint, rec_texts array<string>, dt_polys array<array<array<double>>>, rec_scores array<double>, error string"
ANSWERS = "image_id bigint, raw string, error string"


def run_ocr(images: DataFrame, engine: Callable[[], Callable[[bytes], dict]]) -> DataFrame:
    """ocr_raw rows with an error column: engine() is built once for each partition and reads one image's bytes.

    It returns {"rec_texts", "dt_polys", "rec_scores"}; what it raises becomes the image's error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for pdf in frames:
            out = []
            for image_id, content in zip(pdf["image_id"], pdf["content"], strict=True):
                try:
                    found = read(bytes(content))
                    out.append((image_id, found["rec_texts"], found["dt_polys"], found["rec_scores"], None))
                except Exception as e:  # noqa: BLE001  one bad image must not end the batch
                    out.append((image_id, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["image_id", "rec_texts", "dt_polys", "rec_scores", "error"])

    return images.select("image_id", "content").mapInPandas(run, OCR_RAW)


def run_detector(vision_requests: DataFrame, caller: Callable[[], Callable[[str, str], str]], concurrency: int = 8) -> DataFrame:
    """llm_responses rows with an error column; as many calls at a time as there are partitions (concurrency)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = caller()
        for pdf in frames:
            out = []
            for image_id, payload, prompt in zip(pdf["image_id"], pdf["payload"], pdf["prompt"], strict=True):
                try:
                    out.append((image_id, call(payload, prompt), None))
                except Exception as e:  # noqa: BLE001
                    out.append((image_id, None, str(e)))
            yield pd.DataFrame(out, columns=["image_id", "raw", "error"])

    return vision_requests.select("image_id", "payload", "prompt").repartition(concurrency).mapInPandas(run, ANSWERS)

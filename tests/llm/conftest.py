from __future__ import annotations

import pytest


@pytest.fixture
def rows(spark):
    """Makes a frame of ids and texts with extra columns whose names clash with those the operators use."""

    def make(data, key="number", text="body_text"):
        clash = "key string, same string, class_id string, _text string, clean string, kinds string, raw string, score string, ids string"
        return spark.createDataFrame([(*r, *["x"] * 9) for r in data], f"{key} bigint, title string, {text} string, {clash}")

    return make

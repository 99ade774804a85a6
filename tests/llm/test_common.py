from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common

PIECES = st.sampled_from(["a", "B", "é", " ", "\n", "\x1c", "word", "\x0b", "wördß", "  "])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=12).map("".join)), max_size=8), st.sampled_from([1, 3, 7, 1 << 20]))
def test_words_do_not_depend_on_blocks(texts, block):
    words = common.Words()
    words.BLOCK = block
    data, offsets = common.string_bytes(pa.array(texts, pa.string()))
    hashes, at = words(data, offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    names: dict = {}
    for w, h in zip([w for ws in want for w in ws], hashes.tolist(), strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_string_bytes_of_slices_and_nulls():
    column = pa.array(["aa", None, "é", ""]).slice(1)
    data, offsets = common.string_bytes(column)
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 2, 2]
    assert common.string_bytes(pa.array([], pa.string()))[1].tolist() == [0]
    assert list(common.slices(np.array([0, 5, 6, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_tables_are_dropped(spark):
    kept = common.written(spark.range(3), "t")
    assert kept.count() == 3 and common.drop_written(spark) >= 1
    assert not common._WRITTEN


def test_tables_on_the_way_go_when_the_result_is_stored(spark):
    from pathlib import Path

    def make():
        left, right = common.written(spark.range(3), "left"), common.settled(lambda: common.written(spark.range(2), "inner"), "right")[0]
        return left.join(right, "id")

    before = set(common._WRITTEN)
    frame, path = common.settled(make, "result")
    assert frame.count() == 2 and set(common._WRITTEN) - before == {path}
    root = Path(common.shared_dir(spark).removeprefix("file://"))
    assert not [p for p in root.iterdir() if any(p.name.startswith(f"tessera-{n}-") for n in ("left", "inner", "right"))]


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class getConf:  # noqa: N801
                @staticmethod
                def get(key, default=None):
                    return default

    try:
        common.shared_dir(Session)
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("a local folder stood in")

"""Expiring click deduplication against a plain replay."""

import datetime as dt
import hashlib
import os
import zlib

from weft.llm import clicks

EPOCH = dt.datetime(1970, 1, 1)


def replay(rows, batches):
    crc = lambda s: zlib.crc32(s.encode())
    copies = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or click < 0 or arrived is None:
            continue
        for j in range(click % 3 + 1):
            c = crc(f"{click}:{j}")
            hour = (arrived - EPOCH) // dt.timedelta(hours=1) + 6 * j * (c % 10)
            import math

            parts = (client, kind, None if value is None else math.floor(100 * value + 0.5), None if ts is None else (ts - EPOCH) // dt.timedelta(microseconds=1), props, c % 3)
            text = "|".join("" if x is None else str(x) for x in parts)
            copies.append((click, hour, hour + c // 10 % 200, hashlib.sha256(text.encode()).hexdigest()))
    if not copies:
        return []
    lo, hi = min(x[2] for x in copies), max(x[2] for x in copies)
    dealt = [[] for _ in range(batches)]
    for click, hour, at, mark in copies:
        dealt[(at - lo) * batches // (hi - lo + 1)].append((click, hour, mark))
    out, held, m = [], {}, None
    for k, own in enumerate(dealt):
        for click, hour, mark in sorted(x for x in own if not k or x[1] >= m - 24):
            w = held.get(click)
            if w and hour > w[1] + 48:
                out.append((*w, k))
                w = None
            if w is None:
                held[click] = [click, hour, 0, 0, 0, mark]
            else:
                w[2] += 1
                if mark != w[5]:
                    w[3] += 1
                    w[4] += crc(mark)
        m = max([x[1] for x in own] + [m] * (m is not None))
        for click in [c for c, w in held.items() if k == batches - 1 or w[1] + 48 < m - 24]:
            out.append((*held.pop(click), k))
    return sorted(out)


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, bucket int, n long"


def test_replay(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=h % 60, microseconds=h)
    rows = [(i % 60, at(i * 3), at(i * 7 % 900), i % 5, "a|b" if i % 3 else None, i / 8 - 3, None if i % 4 else '{"k": 1}') for i in range(300)]
    rows += [(5, at(1), at(1), 1, "x", 1.005, "")] * 3 + [(2, None, at(400), None, None, None, None), (None, at(1), at(1), 1, "x", 1.0, ""), (-4, at(1), at(1), 1, "x", 1.0, ""), (8, at(1), None, 1, "x", 1.0, "")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    for batches in (1, 4):
        got = clicks.windows(spark, df, batches, 6).collect()
        mine = sorted((r.click_id, r.start_hour, r.n_repeats, r.n_conflicts, r.conflict_crc, r.hash.hex(), r.closed_batch) for r in got)
        assert mine == replay(rows, batches)
        assert sum(x[2] for x in mine) > 100
    assert clicks.windows(spark, df.limit(0)).count() == 0


def test_pages_keep_windows():
    windows = {3: [10, 1, 0, 0, b"a" * 32], 9: [-5, 2, 1, 2**40, b"\x00" * 32]}
    assert clicks.unpack(clicks.pack(windows)) == windows
    closed = []
    clicks.fold(windows, [(3, 58, b"b" * 32, 2, 7), (3, 59, b"c" * 32, 3, 9), (4, 1, b"d" * 32, 1, 5)], 2, closed)
    assert closed == [(3, 10, 3, 2, 14, b"a" * 32, 2)]
    assert windows[3] == [59, 2, 0, 0, b"c" * 32] and windows[4] == [1, 0, 0, 0, b"d" * 32]


def test_stores_hold_no_native_memory(spark, monkeypatch):
    """Every start opens a store for each shuffle partition, so none may leave memory behind outside the heap."""
    files, drop = [], clicks.Scratch.drop

    def look(self, *labels):
        if "checkpoint" in labels:
            files.extend(f"{d}/{x}" for d, _, names in os.walk(self.paths["checkpoint"].removeprefix("file:") + "/state/0") for x in names)
        drop(self, *labels)

    monkeypatch.setattr(clicks.Scratch, "drop", look)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(i % 90, at(i), at(i * 7 % 400), i % 5, "a", 1.0, "", 1, 1) for i in range(300)]
    assert clicks.windows(spark, spark.createDataFrame(rows, SCHEMA), 4).count()
    kinds = {os.path.splitext(x)[1] for x in files if "/_metadata/" not in x} - {".crc"}
    assert ".snapshot" in kinds and kinds <= {".delta", ".snapshot"}, kinds

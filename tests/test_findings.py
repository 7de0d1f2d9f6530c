"""What the findings of round 3 named, each on input that went wrong before."""

from __future__ import annotations

import math
from fractions import Fraction

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from emberframe.llm import curriculum, near_dedup, packing, tokens
from emberframe.operators import contours, rasters, surfaces
from emberframe.session import stored
from emberframe.sources import feeds


def test_deviation_of_a_cell_that_one_detection_dominates(spark):
    """the weights' ratio is 10^12, so the deviation is some seconds of a month."""
    rows = [(64.005, 10.005, 1_704_067_211), (64.005, 10.02, 1_706_600_000), (64.01, 9.995, 1_705_000_000)]
    found = {(r.row, r.col): r for r in surfaces.arrival(spark.createDataFrame(rows, "latitude double, longitude double, acq_ts long"), 0.01, 2.0, 1_706_745_600).collect()}
    y, x = 6400.5 * 0.01, 1000.5 * 0.01
    km = [math.hypot((lon - x) * 111.32 * math.cos(math.radians(lat)), (lat - y) * 110.574) for lat, lon, _ in rows]
    seen = [(Fraction(1 / (k * k * 1e6 + 1e-6)), t) for k, (_, _, t) in zip(km, rows, strict=True) if k <= 2]
    whole = sum(w for w, _ in seen)
    mean = sum(w * t for w, t in seen) / whole
    deviation = math.sqrt(sum(w * (t - mean) ** 2 for w, t in seen) / whole)
    got = found[6400, 1000]
    assert got.n == len(seen) == 3
    assert abs((got.latest - got.earliest) / 2 - deviation) < 1e-6
    assert abs(got.median - float(mean)) < 1e-6


def test_cells_of_a_tile_are_summed_in_its_task(spark, monkeypatch):
    """points are dealt before cells become rows, so a task doesn't hold the cells of all of them; tiles lose and double no cell."""
    monkeypatch.setattr(surfaces, "IN_TASK", 10)
    rows = [(i, (i * 37 % 101) * 0.02 - 1, (i * 53 % 97) * 0.02 - 1, 0.5 + i % 3) for i in range(120)]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double, reach double").coalesce(1)
    from pyspark.sql import functions as F

    near = surfaces.near_cells(points, 0.01, F.col("reach"))
    assert near.rdd.getNumPartitions() == 12
    expected = set()
    for i, lat, lon, reach in rows:
        for row in range(math.floor(lat * 100) - 30, math.floor(lat * 100) + 31):
            for col in range(math.floor(lon * 100) - 30, math.floor(lon * 100) + 31):
                if math.hypot((lon - (col + 0.5) * 0.01) * 111.32 * math.cos(math.radians(lat)), (lat - (row + 0.5) * 0.01) * 110.574) <= reach:
                    expected.add((i, row, col))
    found = [(r.id, r.row, r.col) for r in near.select("id", "row", "col").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert near.groupBy(*surfaces.CELL).count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_only_chains_that_cross_blocks_are_joined(spark, monkeypatch):
    """a ring within its block needs no component; the edges that are joined are where chains leave their blocks."""
    sizes, joined = [], contours.components
    monkeypatch.setattr(contours, "components", lambda edges: sizes.append(edges.count()) or joined(edges))
    across = [(r, c) for r in range(60, 70) for c in range(60, 140)]
    cells = [(1, r, c, 1.0) for r, c in [(10, 10), (10, 30), (30, 10), *across]]
    grids = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0, 200, 200), (2, 2.0, 0.0, 4.0, 2.0, 200, 200)], "grid_id long, west double, south double, east double, north double, nx long, ny long")
    levels = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 0.5)], "grid_id long, level double")
    blocks = rasters.blocks(spark.createDataFrame(cells, "grid_id long, row long, col long, value double"))
    found = contours.measured(contours.ringed(contours.segments(blocks, grids, levels))).collect()
    assert sorted((r.level, r.n_points) for r in found) == [(level, n) for level in (0.25, 0.5) for n in (4, 4, 4, 180)]
    assert all(r.area > 0 for r in found)
    assert sizes == [24]  # of 384 pieces: a level's ring crosses six times from block to block


def test_sentences_are_parsed_once(spark):
    """reports and refusals are made of stored sentences, so no checksum is worked out again for each of their joins."""
    rmc, gga = "$GPRMC,123519,A,4807.038,N,01131.000,E,022.4,084.4,230394,003.1,W*6A", "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47"
    rows = [(1, "T1", 1_705_000_000, f"{gga}\r\nnoise\n{rmc}"), (2, "T2", 1_705_000_000, rmc.replace("6A", "6B")), (3, "T3", 1_705_000_000, "$GPGSV,1,1"), (4, " ", 1_705_000_000, rmc)]
    taken, refused = feeds.fixes_of(spark.createDataFrame(rows, "payload_id long, callsign string, received long, body string"))
    for found in (taken, refused):
        assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.payload_id, r.callsign, r.sentences) for r in taken.collect()] == [(1, "T1", "GGA,RMC")]
    assert sorted((r.payload_id, r.reason) for r in refused.collect()) == [(2, "checksum"), (3, "no_positions"), (4, "callsign")]


def test_packing_encodes_little_at_once(monkeypatch):
    """pipeline, packing: what a worker holds beside its texts follows from the bytes that are encoded together; ids don't."""
    encoder, sizes = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), batch=packing.TEXTS), []
    inner = encoder._batch
    monkeypatch.setattr(encoder, "_batch", lambda texts: sizes.append(sum(map(len, texts.to_pylist()))) or inner(texts))
    texts = pa.array([f"word{i % 7} and line {i % 300}\n" * 2000 for i in range(200)])
    found = list(encoder.encode(texts))
    assert max(sizes) <= packing.TEXTS == 2_000_000 and sum(sizes) == sum(map(len, texts.to_pylist()))
    assert found[:3] == [x.astype("<u4").tobytes() for x in encoder._ids(texts[:3].to_pylist())]


def test_mixing_shuffles_texts_once(spark, monkeypatch):
    """pipeline, mixing: texts go straight to their part of the training time; joining and then sorting them moved each text twice."""
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 8)
    rows = [(None if i % 10 == 0 else i // 3, "a b " * (i * 37 % 41), (None, "", "x", "y")[i % 4], i) for i in range(400)]  # equal ids, also of different sizes and sources
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, source string, time long").repartition(3), "docs")
    monkeypatch.setattr(curriculum, "BROADCAST_BUCKETS", -1)
    joined = [tuple(r) for r in curriculum.mix(docs).collect()]
    monkeypatch.setattr(curriculum, "BROADCAST_BUCKETS", 100_000)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in ("-1", held):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            mixed = curriculum.mix(docs)
            plan = mixed._jdf.queryExecution().executedPlan().toString()
            moves = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
            assert len(moves) == 2 and all("shufflepartitionid" in line for line in moves)  # texts, and the plan's rows without them
            assert [tuple(r) for r in mixed.collect()] == joined and len(joined) > 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_packing_of_files_moves_no_text(spark):
    """pipeline, packing: files that stand in order are packed as they are read; each id once, sequences gapless and in the files' order."""
    docs = stored(spark.range(900).selectExpr("id AS doc_id", "repeat(concat('w', id % 7, ' '), cast(id * 131 % 900 as int)) AS text").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id"), "docs")
    packed = corpus_pipeline.pack(spark, docs, "")
    plan = packed._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert "Exchange" not in plan
    rows = packed.orderBy("sequence_id", "offset").collect()
    ends = {}
    for r in rows:
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 1024
        ends[r.sequence_id] = r.offset + r.length
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values()) and len({r.doc_id for r in rows}) == 900
    by_file = {}
    for r in rows:
        by_file.setdefault(r.sequence_id >> packing.WINDOW_BITS + packing.ROW_BITS, []).append(r.doc_id)
    found = [by_file[f] for f in sorted(by_file)]
    assert len(found) == 3 and all(max(a) < min(b) for a, b in zip(found, found[1:], strict=False))
    assert packing.first_sequence((5 << 40) + 7) > packing.first_sequence(5 << 40) + 7 * (1 << packing.WINDOW_BITS) - 1


def test_large_nodes_are_parted_by_set_size(spark, monkeypatch):
    """op5: unlike members of a node, which branching hands down BRANCHES times each, are first parted by their sizes; similar ones stay together."""
    sizes = [4, 5, 8, 10, 16, 20, 80, 99, 100, 125, 126]
    members = spark.createDataFrame([(i, 1, i, len(sizes), n) for i, n in enumerate(sizes)], "id long, node long, component long, size long, n long")
    nodes = {}
    for r in near_dedup.by_size(members, (80, 100)).collect():
        nodes.setdefault(r.id, set()).add(r.node)
    assert all(nodes[i] & nodes[j] for i, n in enumerate(sizes) for j, m in enumerate(sizes) if 100 * min(n, m) >= 80 * max(n, m))
    assert not nodes[0] & nodes[4] and all(len(found) <= 2 for found in nodes.values())
    parted, by_size = [], near_dedup.by_size
    monkeypatch.setattr(near_dedup, "FEW", 200)
    monkeypatch.setattr(near_dedup, "by_size", lambda m, similarity: parted.append(m.count()) or by_size(m, similarity))
    line = " ".join(f"line{i}" for i in range(60))
    texts = [(i, f"{line} " + " ".join(f"own{i}x{j}" for j in range(int(8 * 1.3 ** (i % 12)))) + (" end" if i > 40 else "")) for i in [*range(40), *range(52, 60)]]
    texts += [(100 + i, text + " tail") for i, text in texts[11::12]]
    found = {r.doc_id: r.component_id for r in near_dedup.near_groups(stored(spark.createDataFrame(texts, "doc_id long, text string"), "docs"), words=4).collect()}
    assert all(found[100 + i] == i for i in found if 100 + i in found)
    assert sum(parted) > 0

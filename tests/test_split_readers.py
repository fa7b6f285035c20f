"""Matrix files read by ranges of a few bytes against what they hold."""

import random

import pytest

from gridweave.sources import matrices
from gridweave.sources import split_readers as sr


@pytest.fixture(params=[64, 1 << 20])
def small_ranges(spark, request):
    """Ranges of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def cells(df):
    return sorted((r.i, r.j, r.v) for r in df.collect())


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def random_cells(seed, m=30, k=40):
    rng = random.Random(seed)
    return sorted({(rng.randrange(m), rng.randrange(k)) for _ in range(200)} - {(7, j) for j in range(k)})


def smtx(entries, m, k):
    starts = [sum(i < r for i, _ in entries) for r in range(m + 1)]
    return f"{m}, {k}, {len(entries)}\n{' '.join(map(str, starts))} \n{' '.join(str(j) for _, j in entries)}"


def test_smtx_by_ranges(small_ranges, tmp_path):
    entries = random_cells(1)
    path = write(tmp_path, "a.smtx", smtx(entries, 30, 40))
    write(tmp_path, "b.smtx", smtx([(0, 3), (1, 1)], 2, 5).replace("\n", "\r\n"))
    write(tmp_path, "c.smtx", smtx([], 3, 5))
    want = [(i, j, 1.0) for i, j in entries]
    assert cells(sr.read_smtx_ranges(small_ranges, path)) == want == cells(matrices.read_smtx(small_ranges, path))
    every = sr.read_smtx_ranges(small_ranges, str(tmp_path)).collect()
    assert sorted((r.matrix_id[-6:], r.i, r.j) for r in every) == [("a.smtx", i, j) for i, j in entries] + [("b.smtx", 0, 3), ("b.smtx", 1, 1)]
    assert cells(sr.read_smtx_ranges(small_ranges, path, rows=(5, 12))) == [c for c in want if 5 <= c[0] < 12]


def test_smtx_is_written_by_parts(small_ranges, tmp_path):
    entries = random_cells(2)
    nz = small_ranges.createDataFrame([(i, j, 2.0) for i, j in entries], "i long, j long, v double").repartition(4)
    sr.write_smtx_parts(nz, 30, 40, str(tmp_path / "m"))
    assert cells(sr.read_smtx_ranges(small_ranges, str(tmp_path / "m"), parts=True)) == [(i, j, 1.0) for i, j in entries]
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    whole = write(tmp_path, "whole.smtx", text)
    assert cells(matrices.read_smtx(small_ranges, whole)) == [(i, j, 1.0) for i, j in entries]
    assert text.split("\n")[0] == f"30, 40, {len(entries)} "


@pytest.mark.parametrize("layout", ["coordinate", "array"])
@pytest.mark.parametrize("kind", ["general", "symmetric", "skew-symmetric"])
def test_matrix_market_by_ranges(small_ranges, tmp_path, layout, kind):
    n, rng = 9, random.Random(3)
    full = [[rng.choice([0, 0, rng.randint(1, 9) / 2]) for _ in range(n)] for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            if kind != "general":
                full[j][i] = -full[i][j] if kind == "skew-symmetric" else full[i][j]
        if kind == "skew-symmetric":
            full[i][i] = 0
    stored = [(i, j) for j in range(n) for i in range(n) if kind == "general" or i > j or (i == j and kind == "symmetric")]
    if layout == "array":
        body = "\n".join(str(full[i][j]) for i, j in stored)
        head = f"{n} {n}"
    else:
        body = "\n".join(f"{i + 1} {j + 1} {full[i][j]}" for i, j in stored if full[i][j])
        head = f"{n} {n} {sum(bool(full[i][j]) for i, j in stored)}"
    path = write(tmp_path, "a.mtx", f"%%MatrixMarket matrix {layout} real {kind}\n% a comment\n\n{head}\n{body}\n")
    assert cells(sr.read_mtx_ranges(small_ranges, path)) == [(i, j, full[i][j]) for i in range(n) for j in range(n) if full[i][j]]


def test_matrix_market_patterns_and_many_files(small_ranges, tmp_path):
    write(tmp_path, "a.mtx", "%%MatrixMarket matrix coordinate pattern general\n3 3 2\n1 1\n3 2\n")
    write(tmp_path, "b.mtx", "%%MatrixMarket matrix array real general\n2 2\n1\n0\n5\n-1.5\n")
    write(tmp_path, "c.mtx", "")
    got = sr.read_mtx_ranges(small_ranges, str(tmp_path)).collect()
    assert sorted((r.matrix_id[-5:], r.i, r.j, r.v) for r in got) == [("a.mtx", 0, 0, 1.0), ("a.mtx", 2, 1, 1.0), ("b.mtx", 0, 0, 1.0), ("b.mtx", 0, 1, 5.0), ("b.mtx", 1, 1, -1.5)]


@pytest.mark.parametrize("block", [(2, 2), (1, 1), (1, 3), (3, 1)])
def test_tiles_of_block_files(small_ranges, tmp_path, block):
    rng = random.Random(block[0] * 10 + block[1])
    tiles = [[] if t % 4 == 1 else [None] * rng.randint(1, 3) for t in range(11)]
    want, lines = [], ["40 40", f"{block[0]} {block[1]}", "8 8", str(len(tiles))]
    for t, blocks in enumerate(tiles):
        lines.append(str(len(blocks)))
        for b in range(len(blocks)):
            values = [float(rng.randint(0, 3)) for _ in range(block[0] * block[1])]
            rows, cols = [rng.randint(0, 9) for _ in range(block[0])], [rng.randint(0, 9) for _ in range(block[1])]
            want.append((t, b, values, rows, cols))
            lines += [" ".join(map(str, x)) for x in ([int(v) for v in values], rows, cols)]
    path = write(tmp_path, "a.coob", "\n".join(lines) + "\n")
    got = sr.read_tiled_blocks(small_ranges, path).collect()
    assert sorted((r.tile, r.block, r["values"], r.rows, r.cols) for r in got) == want


def test_blocks_go_through_files(small_ranges, tmp_path):
    rows = [(0, 0, [1.0, 2.0], [3], [4, 5]), (2, 0, [1.5, 0.0], [9], [4, 6]), (2, 1, [7.0, 8.0], [8], [1, 2])]
    df = small_ranges.createDataFrame(rows, "tile long, block long, values array<float>, rows array<long>, cols array<long>")
    sr.block_lines(df, 10, 10, (1, 2), (4, 4), 4).orderBy("place").select("value").write.text(str(tmp_path / "b"))
    got = sr.read_tiled_blocks(small_ranges, str(tmp_path / "b"), parts=True)
    assert sorted((r.tile, r.block, r["values"], r.rows, r.cols) for r in got.collect()) == rows
    assert cells(matrices.blocks_to_coo(got))[0] == (3, 4, 1.0)


def test_log_that_grows(spark, tmp_path):
    from gridweave.sources import logs

    path = str(tmp_path / "log")
    logs.append_growing(spark.createDataFrame([("a", 1), ("b", None)], "name string, nnz int"), path)
    logs.append_growing(spark.createDataFrame([("c", 0.5, "x,y")], "name string, `time median` double, note string"), path)
    logs.append_growing(spark.createDataFrame([("d", 4)], "name string, nnz int"), path)
    made = logs.read_growing(spark, path)
    assert sorted(made.columns) == ["name", "nnz", "note", "time median"]
    got = sorted((r.name, r.nnz, r["time median"], r.note) for r in made.collect())
    assert got == [("a", 1, None, None), ("b", None, None, None), ("c", None, 0.5, "x,y"), ("d", 4, None, None)]

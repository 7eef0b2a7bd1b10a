import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfacelab.sources import zarr as Z


def cube(rows):
    rows = rows.collect()
    return {(r.z, r.y, r.x): r.v for r in rows}


def stored(folder, values, chunk, compressor=None, separator=".", skip=(), fill=0, order="C"):
    """A store written by hand, for what others have written."""
    os.makedirs(folder)
    shape = values.shape
    for key in np.ndindex(*[-(-s // c) for s, c in zip(shape, chunk)]):
        if key in skip:
            continue
        block = np.zeros(chunk, values.dtype)
        part = values[tuple(slice(k * c, (k + 1) * c) for k, c in zip(key, chunk))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        data = block.tobytes(order)
        if compressor == "zlib":
            data = zlib.compress(data)
        elif compressor == "zstd":
            import zstandard

            data = zstandard.ZstdCompressor().compress(data)
        name = os.path.join(folder, separator.join(map(str, key)))
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "wb") as f:
            f.write(data)
    with open(os.path.join(folder, ".zarray"), "w") as f:
        json.dump({"zarr_format": 2, "shape": shape, "chunks": chunk, "dtype": values.dtype.str, "compressor": compressor and {"id": compressor}, "fill_value": fill, "order": order, "filters": None, "dimension_separator": separator}, f)


VALUES = np.random.default_rng(0).integers(1, 200, (7, 9, 10)).astype("u1")


@pytest.mark.parametrize("compressor, separator, order", [(None, ".", "C"), ("zlib", "/", "F"), ("zstd", ".", "C")])
def test_stores_are_read_back_with_clipped_edges_and_missing_chunks(spark, tmp_path, compressor, separator, order):
    path = f"{tmp_path}/store"
    stored(path, VALUES, (3, 4, 4), compressor, separator, skip={(0, 0, 0)}, order=order)
    want = {p: float(v) for p, v in np.ndenumerate(VALUES) if not (p[0] < 3 and p[1] < 4 and p[2] < 4)}
    assert cube(Z.read_volume(spark, path)) == want
    stored(f"{tmp_path}/filled", VALUES, (3, 4, 4), compressor, separator, skip={(0, 0, 0)}, fill=9, order=order)
    got = cube(Z.read_volume(spark, f"file://{tmp_path}/filled"))
    assert len(got) == VALUES.size and got[0, 0, 0] == 9 and got[2, 3, 3] == 9


def test_a_box_opens_only_its_chunks(spark, tmp_path):
    path = f"{tmp_path}/store"
    stored(path, VALUES, (3, 4, 4), "zlib")
    for name in os.listdir(path):
        if name[0] != "." and not (name[0] in "01" and name[2] == "1"):
            with open(f"{path}/{name}", "wb") as f:
                f.write(b"broken")
    box = {"z": (1, 5), "y": (4, 8)}
    want = {p: float(v) for p, v in np.ndenumerate(VALUES) if 1 <= p[0] < 5 and 4 <= p[1] < 8}
    assert cube(Z.read_volume(spark, path, box)) == want
    by_chunk = spark.read.format("zarr").load(path).where("cz IN (0, 1) AND cy = 1 AND cx > 0 AND v >= 100")
    assert cube(by_chunk) == {p: v for p, v in ((p, float(v)) for p, v in np.ndenumerate(VALUES)) if p[0] < 6 and 4 <= p[1] < 8 and p[2] >= 4 and v >= 100}
    assert spark.read.format("zarr").load(path).where("z < 0").count() == 0
    with pytest.raises(Exception, match="incorrect header|Error -3"):
        Z.read_volume(spark, path).count()


def test_ranges_of_chunks_are_partitions():
    reader = Z._BlockReader((100, 64, 64), (10, 32, 32), 8)
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 40)]
    Z.PARTITION_BYTES, before = 10 * 32 * 32 * 8 * 16, Z.PARTITION_BYTES
    try:
        assert [(p.first, p.last) for p in reader.partitions()] == [(0, 16), (16, 32), (32, 40)]
    finally:
        Z.PARTITION_BYTES = before


def test_array_files_are_read_by_slabs(spark, tmp_path):
    path = f"{tmp_path}/a.npy"
    np.save(path, VALUES)
    assert cube(Z.read_volume(spark, path, slab=2)) == {p: float(v) for p, v in np.ndenumerate(VALUES)}
    # Cut behind the third slab: a box before it is still read.
    with open(path, "rb") as f:
        head = f.read()
    with open(path, "wb") as f:
        f.write(head[: len(head) - 3 * 90])
    assert cube(Z.read_volume(spark, path, {"z": (1, 4)}, slab=2)) == {p: float(v) for p, v in np.ndenumerate(VALUES) if 1 <= p[0] < 4}
    np.save(path, np.asfortranarray(VALUES))
    with pytest.raises(Exception, match="C order"):
        Z.read_volume(spark, path).count()


def test_a_written_store_and_its_levels(spark, tmp_path):
    rows = [(z, y, x, float(VALUES[z, y, x])) for z, y, x in np.ndindex(*VALUES.shape) if z != 4]
    df = spark.createDataFrame(rows, "z int, y int, x int, v double").repartition(3)
    for compressor in (None, "zlib", "zstd"):
        path = f"{tmp_path}/{compressor}/0"
        Z.write_zarr(df, path, VALUES.shape, (2, 5, 5), "<u2", compressor)
        got = cube(Z.read_volume(spark, path))
        assert got == {p: float(v) * (p[0] != 4) for p, v in np.ndenumerate(VALUES)}
    attributes = {"multiscales": [{"datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [4.0, 2.0, 2.0]}, {"type": "translation", "translation": [8.0, 0.0, 2.0]}]}]}]}
    with open(f"{tmp_path}/zstd/.zattrs", "w") as f:
        json.dump(attributes, f)
    voxels, scale, offset = Z.open_ome(spark, f"{tmp_path}/zstd", 0, {"x": (0, 1)})
    assert scale == [4.0, 2.0, 2.0] and offset == [2.0, 0.0, 1.0] and voxels.agg(F.max("x")).first()[0] == 0
    with pytest.raises(ValueError, match="no level 3"):
        Z.open_ome(spark, f"{tmp_path}/zstd", 3)


def test_what_cannot_be_read_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no array of Zarr"):
        Z.read_volume(spark, f"{tmp_path}/nothing").count()
    with pytest.raises(ValueError, match="blosc"):
        Z.decoded(b"", {"id": "blosc"})

"""Registered queries over whole tables: against the SQL where it covers the table, else against brute force."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lamella.plans import queries as arrays

TALL, WIDTH = 70, 64


def table(folder, rows):
    e = np.random.default_rng(2).normal(size=(max(rows, TALL), WIDTH)).astype(np.float32)[:rows]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    t = pa.table({"vec_id": pa.array(np.arange(rows)), "embedding": pa.array(list(e), pa.list_(pa.float32()))})
    pq.write_table(t, f"{folder}/embeddings.parquet")
    return str(folder), np.floor((e.astype(float) + 1) * 127).astype(np.int64)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def sql_rows(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    return sorted(con.execute(arrays.SQL[name]).fetchall())


def brute_labels(on):
    out = np.zeros(on.shape, np.int64)
    for y, x in zip(*np.nonzero(on)):
        if out[y, x]:
            continue
        out[y, x] = name = y * on.shape[1] + x + 1
        todo = [(y, x)]
        while todo:
            b, a = todo.pop()
            for v in range(max(b - 1, 0), min(b + 2, on.shape[0])):
                for u in range(max(a - 1, 0), min(a + 2, on.shape[1])):
                    if on[v, u] and not out[v, u]:
                        out[v, u] = name
                        todo.append((v, u))
    return out


def test_labels_cover_the_whole_image(spark, tmp_path):
    folder, v = table(tmp_path, TALL)
    want = brute_labels(v > 140)
    assert (want[32:] > 32 * WIDTH).any()
    cells = lambda a: sorted((y, x, a[y, x]) for y in range(TALL) for x in range(WIDTH))
    run = lambda name: rows_of(arrays.QUERIES[name](spark, folder))
    assert run("label_components") == cells(want)
    names = np.unique(want[want > 0])
    dense = np.where(want > 0, np.searchsorted(names, want) + 1, 0)
    assert run("label_dense") == cells(dense) and run("label_extract") == cells((dense == 3).astype(int))
    at = {n: np.nonzero(want == n) for n in names}
    area = {n: len(at[n][0]) for n in names}
    assert run("label_properties") == [(n, area[n], v[at[n]].max(), round(v[at[n]].mean() * 1e6)) for n in names]
    assert run("label_boxes") == [(n, at[n][0].min(), at[n][0].max(), at[n][1].min(), at[n][1].max()) for n in names]
    assert run("label_upsert") == [(n, area[n] * 10 if area[n] > 2 else area[n]) for n in names]
    convex = run("label_convex")
    assert [r[:2] for r in convex] == [(n, area[n]) for n in names] and all(r[2] >= r[1] for r in convex)
    assert {r[0] for r in run("label_colors")} == {0, *names}


@pytest.mark.parametrize("name", ["label_components", "label_dense", "label_properties", "label_boxes", "label_colors", "label_upsert"])
def test_labels_equal_the_sql_where_it_covers_the_table(spark, tmp_path, name):
    folder, _ = table(tmp_path, 32)
    assert rows_of(arrays.QUERIES[name](spark, folder)) == sql_rows(folder, name)


def test_products_medians_and_combinations_cover_the_whole_table(spark, tmp_path):
    n = 430
    folder, v = table(tmp_path, n)
    run = lambda name: rows_of(arrays.QUERIES[name](spark, folder))
    cells = lambda a: sorted((*at, x) for at, x in np.ndenumerate(a))
    m = v[::-1]
    assert run("reduce_prod") == [(y, 0, int(np.prod(1 + v[y] % 2, dtype=float))) for y in range(n)]
    got = run("reduce_nanprod")
    assert [r[:2] for r in got] == [(y, 0) for y in range(n)]
    np.testing.assert_allclose([r[2] for r in got], np.where(v % 11 == 0, 1, v / 127).prod(1) * 1e6, atol=1)
    padded = np.pad(v, ((0, -n % 3), (0, -WIDTH % 3)))
    blocks = padded.reshape(padded.shape[0] // 3, 3, padded.shape[1] // 3, 3).transpose(0, 2, 1, 3).reshape(padded.shape[0] // 3, -1, 9)
    assert run("downscale_median") == cells(np.trunc(np.median(blocks, axis=2)).astype(int))
    assert run("combine_stack") == cells(np.stack([v, m]))
    assert run("combine_mosaic") == cells(np.block([[v, m], [m, v]]))
    assert run("create_pad") == cells(np.pad(v, ((2, 1), (0, 3)), constant_values=9))
    collection = arrays.QUERIES["combine_collection"](spark, folder).select("img", "layer", "y", "x", "v")
    assert rows_of(collection) == sorted((y // 200, "0", y % 200, x, v[y, x]) for y in range(n) for x in range(WIDTH))


def test_powers_beyond_64_bits_in_millionths_are_the_nearest_longs(spark, tmp_path):
    v = np.array([[48, 203, 53, 60], [6, 6, 13, 5]])  # the other row's remainder by 7, plus 1, is the exponent
    e = ((v + 0.5) / 127 - 1).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array([0, 1]), "embedding": pa.array(list(e), pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    powers = [[int(v[y, x] - 127) ** int(v[1 - y, x] % 7 + 1) * 10**6 for x in range(4)] for y in (0, 1)]
    assert powers[0][0] < -(2**63) and powers[0][1] > 2**63
    want = np.clip(np.array(powers, object), -(2**63), 2**63 - 1)
    got = rows_of(arrays.QUERIES["ufunc_power"](spark, str(tmp_path)))
    assert [r[:2] for r in got] == [(y, x) for y in (0, 1) for x in range(4)]
    for y, x, n in got:  # doubles of 53 bits
        assert n == want[y, x] if abs(want[y, x]) >= 2**63 - 1 else abs(n - want[y, x]) <= abs(want[y, x]) * 2**-52
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1e303,), (-1e303,), (None,), (1.5e-6,)], "v double")
    assert [r[0] for r in odd.select(arrays.micro(odd["v"])).collect()] == [-(10**15), 10**15, 1 - 10**15, 2**63 - 1, -(2**63), None, 2]

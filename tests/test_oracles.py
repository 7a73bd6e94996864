"""Every registered query of the library against its SQL."""

import pytest

from tests.compare import duck_rows, spark_rows
from tessella.queries import ORACLES, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    names, got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert (names, got) == duck_rows(duck, ORACLES[name])
    else:
        assert got


def test_flagship(spark, sf_dir):
    rows = flagship(spark, sf_dir).collect()
    assert len(rows) == 5 and rows[0]["avg_order_value"] >= rows[4]["avg_order_value"]


def test_whole_tables_are_read(spark, sf_dir):
    events, vectors = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings"))
    assert QUERIES["e_arr_explode_whole"](spark, sf_dir).count() == 2 * events.count()
    assert QUERIES["e_arr_posexplode_whole"](spark, sf_dir).count() == vectors.selectExpr("sum(size(embedding))").first()[0]
    assert QUERIES["c12_bitmap_hour_whole"](spark, sf_dir).count() == events.select("user_id").distinct().count()


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash that Spark's hash() gives a string: whole words first, then each byte that is left as a word of its own."""
    mask = 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    h = seed
    whole = len(data) // 4 * 4
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [(b - 256 if b > 127 else b) & mask for b in data[whole:]]
    for k in words:
        h = (turn(h ^ (turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask), 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def soundex(word: str) -> str:
    codes = {c: str(n) for n, group in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in group}
    word = word.upper()
    out, last = word[0], codes.get(word[0], "")
    for c in word[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


def test_functions_whose_values_are_known_elsewhere(spark, sf_dir):
    import zlib

    import xxhash

    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    for r in QUERIES["e_hash_own"](spark, sf_dir).collect():
        raw = names[r.c_custkey].encode()
        assert (r.c, r.x % 2**64, r.h) == (zlib.crc32(raw), xxhash.xxh64_intdigest(raw, 42), murmur3(raw))
    assert {r.sx for r in QUERIES["e_str_own"](spark, sf_dir).collect()} == {soundex(n.split("#")[0]) for n in names.values()}
    words = ["Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "Miller"]
    said = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "soundex(w) AS s", "hash(w) AS h").collect()
    assert [r.s for r in said] == [soundex(w) for w in words] and [r.h for r in said] == [murmur3(w.encode()) for w in words]


def test_random_columns_are_in_their_range(spark, sf_dir):
    rows = QUERIES["e_math_own"](spark, sf_dir).collect()
    mean = sum(r.r2 for r in rows) / len(rows)
    assert all(0 <= r.r1 < 1 for r in rows) and len({r.r1 for r in rows}) == len(rows) and abs(mean) < 1

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blocklog.functions import addressing, capacity, crypto


@pytest.mark.parametrize(("real", "avail"), [(0, 0), (2097152, 0), (25165824, 21741568), (41943040, 38117376), (2147483648, 2091024384)])
def test_available_sectors(real, avail):
    assert capacity.available_sectors(real) == avail


def test_capacity_of_the_largest_device():
    top = 2**64 - 1
    assert capacity.available_sectors(top) >= top // 100 * 80


def test_full_file():
    assert capacity.tree_levels(131072) == [1, 32, 1024]
    assert capacity.tree_bytes(131072) == 5815513
    assert capacity.tree_height(0) == 0


def test_region_starts_follow_each_other():
    starts, sizes = capacity.region_starts(2880), capacity.regions(2880)
    assert starts["data"] == sum(sizes.values()) == capacity.metadata_blocks(2880) == 96260


def bitwise(seed, data):
    c = seed
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


@given(st.binary(max_size=40), st.integers(0, 2**32 - 1))
def test_crc_is_the_bitwise_one(data, seed):
    assert crypto.crc32_be(data, seed) == bitwise(seed, data)


def test_kdf_vector():
    assert crypto.derive_keys("password", b"salt", 1).hex().startswith("867f70cf1ade02cff3752599a3a53dc4")


def test_key_material_is_checked():
    assert crypto.split_key(bytes(range(64))) == (bytes(range(16)).hex(), bytes(range(16, 28)).hex())
    with pytest.raises(ValueError):
        crypto.split_key(b"short")


def test_cbc_round_trip(spark):
    key, iv = bytes.fromhex("06a9214036b8a15b512e03d534120006"), bytes.fromhex("3dafba429d9eb430b422da802c9fac41")
    for vector in (iv, crypto.seeded_iv(21)):
        row = spark.range(1).select(crypto.cbc_encrypt(F.lit(b"Single block msg"), F.lit(key), F.lit(vector)).alias("s"))
        row = row.select("s", crypto.cbc_decrypt(F.col("s"), F.lit(key)).alias("back")).head()
        assert bytes(row.back) == b"Single block msg" and b"Single" not in bytes(row.s)


def test_addresses(spark):
    rows = spark.createDataFrame([(0,), (8191,), (8192,), (1 << 40,)], "s long")
    b = addressing.sector_to_block(F.col("s"))
    got = rows.select("s", b.alias("b"), addressing.block_to_segment(b).alias("g"), addressing.offset_in_segment(b).alias("o")).collect()
    assert [(r.b, r.g, r.o) for r in got] == [(r.s // 8, r.s // 8 // 1024, r.s // 8 % 1024) for r in got]


def test_quotients_of_longs_are_exact(spark):
    from pyspark.sql import functions as F

    from blocklog.functions.addressing import whole

    n = 9007199254740993 * 500 + 499
    assert spark.range(1).select(whole(F.lit(n), 500).alias("q")).head().q == 9007199254740993

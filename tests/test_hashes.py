"""Hashes and bit expressions against fixed values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallysketch import get_hash, hash_keys, register_hash, register_sql_functions
from tallysketch.functions import bits, u64
from tallysketch.functions.hashes import HASH_NAMES, hash_id, hash_name

KEYS = [0, 1, 2, 42, 100000, 2147483647, 2147483648, 4294967295]
GOLDEN = {
    "MURMUR3_32": "379fae8f dea578e3 69343e96 01c0e12d 0eec1bcc 07fb67e7 2b1f0fc6 a0590e3d",
    "MURMUR3_64": "bff19e360f8cc52e dce6ddaf9b8624a2 069b3dc62d8496c2 657a0cf7411efb56 0736807cc9e0033a"
    " 10acc385666694c5 327e122468a5287f 4b2660d7fb8c1aa5",
    "murmur3_64_h1": "e6d98faf7def3b0e c22829e2b54952ad 493137adcf131144 dc9f7d9aed50afb2 da1fc87ca74a4391"
    " da9c527b9a45ac25 d24c586c03450764 013f0cc2ceac09b3",
    "SIP": "34c0e02aa57e7b58 28273240319c3a72 ae1e0e8163b883c9 80db72021390b4ec 26e20dd64feceaff"
    " 14a49b441cfc142c 9cc6ad7ebc11cc53 2161215ab66feb9e",
}
RANKS = {
    ("IDENT", 14): [(0, 19), (0, 18), (0, 13), (16383, 1)],
    ("SIP", 14): [(3376, 3), (2569, 1), (8246, 1), (2136, 2)],
    ("MURMUR3_32", 14): [(3559, 1), (14249, 2), (112, 3), (10262, 2)],
    ("MURMUR3_64", 14): [(12284, 2), (14137, 1), (6494, 1), (4809, 1)],
    ("murmur3_64_h1", 14): [(14774, 2), (12426, 5), (14119, 1), (79, 1)],
    ("murmur3_64_h1", 16): [(59097, 1), (49704, 3), (56479, 2), (319, 5)],
}


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(k,) for k in KEYS], "key BIGINT")


def unsigned(value):
    return value & (2**64 - 1)


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_hashes(keys, name):
    got = {r.key: unsigned(r.hash) for r in hash_keys(keys, "key", name).collect()}
    assert got == dict(zip(KEYS, (int(x, 16) for x in GOLDEN[name].split())))


def test_identity_and_vector_names(keys):
    assert {r.key for r in hash_keys(keys, "key", "IDENT").where("key = hash").collect()} == set(KEYS)
    assert get_hash("MURMUR3_32AVX") is get_hash("murmur3_32")
    assert get_hash("MURMUR3_64AVX") is get_hash("murmur3_64")


def test_wide_hash_is_both_words(keys):
    rows = hash_keys(keys, "key", "murmur3_128").select("key", "hash.hi", "hash.lo").collect()
    for i, key in enumerate(KEYS):
        row = next(r for r in rows if r.key == key)
        assert unsigned(row.hi) == int(GOLDEN["MURMUR3_64"].split()[i], 16)
        assert unsigned(row.lo) == int(GOLDEN["murmur3_64_h1"].split()[i], 16)


@pytest.mark.parametrize("name,p", RANKS)
def test_golden_buckets_and_ranks(spark, name, p):
    frame = spark.createDataFrame([(k,) for k in (0, 1, 42, 4294967295)], "key BIGINT")
    width = get_hash(name).width
    hashed = hash_keys(frame, "key", name).orderBy("key")
    got = hashed.select(F.expr(bits.bucket_of("hash", width, p)), F.expr(bits.rank_of("hash", width, p))).collect()
    assert [tuple(r) for r in got] == RANKS[(name, p)]


def test_leading_zeros_at_every_width(spark):
    values = sorted({v for n in range(1, 62) for v in (2**n - 1, 2**n, 2**n + 1)} | {0})
    frame = spark.createDataFrame([(v,) for v in values if v < 2**60], "h BIGINT")
    for row in frame.select("h", F.expr(bits.leading_zeros("h", 64, 4)).alias("z")).collect():
        assert row.z == 60 - row.h.bit_length()


def test_wrapping_arithmetic(spark):
    rng = np.random.default_rng(3)
    edge = [0, 1, 2**31, 2**32 - 1, 2**32, 2**62 - 1, 2**62, 2**63 - 1, 2**63, 2**64 - 1]
    values = edge + [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]
    signed = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame(list(zip(signed, reversed(signed))), "a BIGINT, b BIGINT")
    constants = [0, 1, 0x80000000, 0xFFFFFFFFFFFFFFFF, u64.FMIX_C1, 0x8000000080000000, 12345]
    out = frame.select(
        "a", "b", F.expr(u64.add64("a", "b")).alias("sum"), F.expr(u64.rotl64("a", 31)).alias("rot"),
        *[F.expr(u64.mul64("a", k)).alias(f"m{i}") for i, k in enumerate(constants)],
    )
    for row in out.collect():
        a, b = unsigned(row.a), unsigned(row.b)
        assert unsigned(row["sum"]) == (a + b) % 2**64
        assert unsigned(row.rot) == ((a << 31) | (a >> 33)) % 2**64
        for i, k in enumerate(constants):
            assert unsigned(row[f"m{i}"]) == a * k % 2**64


def test_null_keys_are_ignored_and_wrong_keys_raise(spark):
    assert hash_keys(spark.createDataFrame([(None,), (1,)], "key BIGINT"), "key", "murmur3_32").count() == 1
    for bad in (-1, 2**32):
        with pytest.raises(Exception, match="key outside"):
            hash_keys(spark.createDataFrame([(bad,)], "key BIGINT"), "key", "murmur3_32").collect()


def test_names(spark):
    assert [hash_id(n) for n in HASH_NAMES] == list(range(6))
    with pytest.raises(ValueError):
        hash_id("CRC")
    with pytest.raises(ValueError):
        get_hash("CRC")
    with pytest.raises(ValueError):
        register_hash("bad", 48, lambda k: k)
    names = spark.range(7).select(hash_name(F.col("id").cast("int")).alias("n")).collect()
    assert [r.n for r in names] == [*HASH_NAMES, "<undef>"]


def test_arrow_function_as_hash(spark):
    @F.pandas_udf("bigint")
    def low_bits(keys: pd.Series) -> pd.Series:
        return keys & 0xFFFF

    register_hash("low_bits", 32, low_bits)
    got = hash_keys(spark.range(70000).withColumnRenamed("id", "key"), "key", "low_bits")
    assert got.where("hash <> key % 65536").count() == 0


def test_masks(spark):
    lengths = spark.range(0, 70).select("id", F.expr(bits.length_to_keep("id")).alias("keep"))
    for row in lengths.collect():
        assert unsigned(row.keep) == (2**row.id - 1 if 1 <= row.id <= 63 else 2**64 - 1)


def test_sql_functions(spark, keys):
    register_sql_functions(spark)
    keys.createOrReplaceTempView("golden_keys")
    rows = spark.sql(
        "SELECT key, tally_murmur3_32(key) a, tally_murmur3_64(key) b, tally_murmur3_64_h1(key) c FROM golden_keys"
    ).collect()
    for row in rows:
        i = KEYS.index(row.key)
        for value, name in ((row.a, "MURMUR3_32"), (row.b, "MURMUR3_64"), (row.c, "murmur3_64_h1")):
            assert unsigned(value) == int(GOLDEN[name].split()[i], 16)
    assert spark.sql("SELECT tally_murmur3_32(CAST(NULL AS BIGINT)) h").first().h is None

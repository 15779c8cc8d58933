"""Hash functions over key columns, and the registry that names them.

A hash is attached to a DataFrame as a new column.  Multi-step hashes add one projection per step, which keeps the
expression trees small; Catalyst fuses the steps into one generated stage and prunes the helper columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .u64 import add64, bits, fmix64, low32, mul64, rotl64, step

# Fixed values of the hash definitions.
MURMUR3_C1 = 0x87C37B91114253D5
MURMUR3_C2 = 0x4CF5AD432745937F
MURMUR3_SEED = 0xBAADF00D
KEY_LENGTH = 4
SIP_V0 = 0x736F6D6570736575
SIP_V1 = 0x646F72616E646F6D
SIP_V2 = 0x6C7967656E657261
SIP_V3 = 0x7465646279746573
SIP_LENGTH_WORD = 8 << 56
SIP_FINAL = 0xFF
HASH_NAMES = ["IDENT", "SIP", "MURMUR3_32", "MURMUR3_64", "MURMUR3_32AVX", "MURMUR3_64AVX"]
UNDEFINED_NAME = "<undef>"

Attach = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class HashFunction:
    """A named hash: ``attach(df, key, out)`` adds its value as column ``out``.

    32-bit values are zero-extended BIGINTs, 64-bit values are BIGINT bits, 128-bit values are
    ``struct<hi BIGINT, lo BIGINT>``.  ``u32_keys`` hashes accept keys 0..2**32-1 only.
    """

    name: str
    width: int
    attach: Attach
    u32_keys: bool = True


def u32_key(key: str) -> str:
    """A key as BIGINT, raising on values outside 0..2**32-1.  NULLs must have been filtered out."""
    value = f"CAST({key} AS BIGINT)"
    error = f"raise_error(concat('key outside 0..2^32-1: ', CAST({key} AS STRING)))"
    # The zero is never used; it tells the code generator that the result cannot be NULL.
    return f"coalesce(CASE WHEN shiftrightunsigned({value}, 32) = 0 THEN {value} ELSE CAST({error} AS BIGINT) END, 0L)"


def murmur3_32(key: str) -> str:
    """Spark's own ``hash`` is Murmur3 x86-32 with seed 42 over the four key bytes, read as a signed INT."""
    return low32(f"CAST(hash(CAST(shiftright(shiftleft({key}, 32), 32) AS INT)) AS BIGINT)")


def _murmur3_words(df: DataFrame, key: str) -> DataFrame:
    """Add ``__h1`` and ``__h2``, the two words of Murmur3 x64-128 over the four key bytes."""
    seed = bits(MURMUR3_SEED ^ KEY_LENGTH)
    df = step(df, __h1=mul64(key, MURMUR3_C1, narrow=True))
    df = step(df, __h1=mul64(rotl64("__h1", 31), MURMUR3_C2))
    df = step(df, __h1=add64(f"(__h1 ^ {seed})", seed))
    df = step(df, __h2=add64("__h1", seed))
    df = fmix64(df, "__h1", "__h2")
    df = step(df, __h1=add64("__h1", "__h2"))
    return step(df, __h2=add64("__h1", "__h2"))


def _attach_murmur3_h2(df: DataFrame, key: str, out: str) -> DataFrame:
    return step(_murmur3_words(df, key), **{out: "__h2"}).drop("__h1", "__h2")


def _attach_murmur3_h1(df: DataFrame, key: str, out: str) -> DataFrame:
    return step(_murmur3_words(df, key), **{out: "__h1"}).drop("__h1", "__h2")


def _attach_murmur3_128(df: DataFrame, key: str, out: str) -> DataFrame:
    words = "named_struct('hi', __h2, 'lo', __h1)"
    return step(_murmur3_words(df, key), **{out: words}).drop("__h1", "__h2")


def _sip_round(df: DataFrame) -> DataFrame:
    """Two pairs of independent steps ``x += y; y = rotl(y, r) ^ x``, the pairs joined by half-word swaps."""

    def pair(x: str, y: str, r: int) -> tuple[str, str]:
        total = add64(x, y)
        return total, f"({rotl64(y, r)} ^ {total})"

    (v0, v1), (v2, v3) = pair("__v0", "__v1", 13), pair("__v2", "__v3", 16)
    df = step(df, __v0=v0, __v1=v1, __v2=v2, __v3=v3)
    (v0, v3), (v2, v1) = pair(rotl64("__v0", 32), "__v3", 21), pair("__v2", "__v1", 17)
    return step(df, __v0=v0, __v1=v1, __v2=rotl64(v2, 32), __v3=v3)


def _attach_sip(df: DataFrame, key: str, out: str) -> DataFrame:
    """Six add-rotate-xor rounds between two mixes of the message word."""
    message = f"({key} | {bits(SIP_LENGTH_WORD)})"
    df = step(df, __v0=bits(SIP_V0), __v1=bits(SIP_V1), __v2=bits(SIP_V2), __v3=f"({bits(SIP_V3)} ^ {message})")
    for _ in range(2):
        df = _sip_round(df)
    df = step(df, __v0=f"(__v0 ^ {message})", __v2=f"(__v2 ^ {bits(SIP_FINAL)})")
    for _ in range(4):
        df = _sip_round(df)
    return step(df, **{out: "__v0 ^ __v2"}).drop("__v0", "__v1", "__v2", "__v3")


def _by_column(fn: Callable[[Column], Column]) -> Attach:
    return lambda df, key, out: df.withColumn(out, fn(F.col(key)))


def _by_text(fn: Callable[[str], str]) -> Attach:
    return lambda df, key, out: step(df, **{out: fn(key)})


_REGISTRY: dict[str, HashFunction] = {}
_ALIASES = {"sip": "sip_variant", "murmur3_32avx": "murmur3_32", "murmur3_64avx": "murmur3_64"}


def register_hash(
    name: str, width: int, fn: Callable[[Column], Column] | None = None, *, attach: Attach | None = None,
    u32_keys: bool = True, replace: bool = False,
) -> HashFunction:
    """Add a hash under ``name``.  ``fn`` maps the key column to the hash column; ``attach`` is the multi-step form.

    A name that is taken raises unless ``replace`` is set: stored sketches are merged by the name of their hash.
    """
    if width not in (32, 64, 128):
        raise ValueError(f"hash width must be 32, 64 or 128, got {width}")
    if (fn is None) == (attach is None):
        raise ValueError("give exactly one of fn and attach")
    if not replace and (name.lower() in _REGISTRY or name.lower() in _ALIASES):
        raise ValueError(f"hash {name!r} is registered already")
    spec = HashFunction(name.lower(), width, attach or _by_column(fn), u32_keys)
    _REGISTRY[spec.name] = spec
    return spec


def get_hash(name: str | HashFunction) -> HashFunction:
    """Look a hash up by name (any case); unknown names raise."""
    if isinstance(name, HashFunction):
        return name
    lowered = name.lower()
    spec = _REGISTRY.get(_ALIASES.get(lowered, lowered))
    if spec is None:
        raise ValueError(f"unknown hash {name!r}; known: {', '.join(hash_names())}")
    return spec


def hash_names() -> list[str]:
    return sorted(_REGISTRY)


def hash_id(name: str) -> int:
    """Position of a classic hash name; unknown names raise."""
    try:
        return HASH_NAMES.index(name)
    except ValueError:
        raise ValueError(f"unknown hash {name!r}") from None


def hash_name(hash_id_column: Column) -> Column:
    """Classic hash name for an id column, ``<undef>`` outside the table."""
    names = F.array(*[F.lit(n) for n in HASH_NAMES])
    return F.coalesce(F.get(names, hash_id_column), F.lit(UNDEFINED_NAME))


register_hash("ident", 32, attach=_by_text(lambda key: key))
register_hash("murmur3_32", 32, attach=_by_text(murmur3_32))
register_hash("murmur3_64", 64, attach=_attach_murmur3_h2)
register_hash("murmur3_64_h1", 64, attach=_attach_murmur3_h1)
register_hash("murmur3_128", 128, attach=_attach_murmur3_128)
register_hash("sip_variant", 64, attach=_attach_sip)
register_hash("xxhash64", 64, attach=_by_text(lambda key: f"xxhash64({key})"), u32_keys=False)


def check_key_type(df: DataFrame, key: str) -> None:
    """Raise unless the column holds whole numbers: a cast would fold different fractions into one key."""
    kind = df.schema[key].dataType
    whole = isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0
    if not whole and not isinstance(kind, T.NullType):
        raise TypeError(f"key column {key!r} must hold whole numbers, not {kind.simpleString()}; hash other types with xxhash64")


def hash_keys(
    df: DataFrame, key: str, hash: str | HashFunction, out: str = "hash", keep_nulls: bool = False
) -> DataFrame:
    """Check the keys' type and range where the hash needs it, and add the hash as ``out``.

    Rows with a NULL key are dropped, or with ``keep_nulls`` kept with an undefined hash.
    """
    spec = get_hash(hash)
    if not keep_nulls:
        df = df.where(F.col(key).isNotNull())
    if not spec.u32_keys:
        return spec.attach(df, key, out)
    check_key_type(df, key)
    filled = df.withColumn("__key", F.coalesce(F.col(key), F.lit(0)) if keep_nulls else F.col(key))
    return spec.attach(step(filled, __key=u32_key("__key")), "__key", out).drop("__key")

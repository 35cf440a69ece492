"""Character references."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_column, let, literal_map
from .constants import BARE_NAME, ENTITIES, ENTITY_TOKEN, NUMERIC, WINDOWS_1252

_NAMED = {f"&{name};": chr(point) for name, point in sorted(ENTITIES.items())}
_REPLACEMENT = "�"


#: Buckets of the name table, and slots it may have: the first number with which no two names meet.
_BUCKETS, _SLOTS = 128, (409, 421, 431, 433, 439, 443, 449, 457, 461, 463, 467, 479, 487, 491, 499, 503, 509, 521, 523, 541)


def _table(names: list[str], slots: int) -> tuple[list[int], list[str]] | None:
    """Shifts of the buckets with which each name has a slot of its own, and the names by slot; null if there are none.

    A name's crc32 names its bucket; the rest of it plus the bucket's shift is its slot.
    """
    buckets: list[list[tuple[int, str]]] = [[] for _ in range(_BUCKETS)]
    for name in names:
        code = zlib.crc32(name.encode())
        buckets[code % _BUCKETS].append((code // _BUCKETS, name))
    shifts, taken = [0] * _BUCKETS, {}
    for i in sorted(range(_BUCKETS), key=lambda i: -len(buckets[i])):
        for shift in range(slots):
            places = {(code + shift) % slots: name for code, name in buckets[i]}
            if len(places) == len(buckets[i]) and not places.keys() & taken.keys():
                break
        else:
            return None
        shifts[i] = shift
        taken |= places
    return shifts, [taken.get(i, "") for i in range(slots)]


_SHIFTS, _BY_SLOT = next(found for slots in _SLOTS if (found := _table(list(_NAMED), slots)))


def _literals(values: list[str]) -> Column:
    return F.split(F.lit("\x03".join(values)), "\x03")  # folded to one array


def named_character(reference: Column) -> Column:
    """Character of ``&name;``, null if there is none; exact and case-sensitive.

    One slot of a constant table is looked at, whatever the name.
    """
    shifts, names, characters = _literals([str(x) for x in _SHIFTS]).cast("array<int>"), _literals(_BY_SLOT), _literals([_NAMED.get(n, "") for n in _BY_SLOT])

    def found(code: Column) -> Column:
        slot = (F.shiftright(code, _BUCKETS.bit_length() - 1) + F.get(shifts, (code % _BUCKETS).cast("int"))) % len(_BY_SLOT)
        return let(slot.cast("int"), lambda i: F.when(F.get(names, i) == reference, F.get(characters, i)))

    return let(F.crc32(reference.cast("binary")), found)


def character(number: Column) -> Column:
    """Character of a numeric reference (bigint up to 2**32 - 1)."""
    legacy = F.try_element_at(literal_map({str(n): chr(p) for n, p in WINDOWS_1252.items()}), number.cast("string"))
    # a first U+FEFF is taken for the byte order's mark, so one stands before every character
    real = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(number), 8, "0"))), "UTF-32")
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit(_REPLACEMENT))
        .when(number.between(0x80, 0x9F), F.coalesce(legacy, F.lit(_REPLACEMENT)))
        .otherwise(real)
    )


def _number(reference: Column) -> Column:
    """Value of a well-formed numeric reference; null beyond 32 bits."""
    digits = F.regexp_extract(reference, "^&#[xX]?\\+?0*([0-9a-fA-F]*);$", 1)
    is_hex = reference.rlike("^&#[xX]")

    def parsed(d: Column) -> Column:
        decimal = F.when(F.length(d) <= 10, F.coalesce(F.try_to_number(d, F.lit("9999999999")).cast("bigint"), F.lit(0).cast("bigint")))
        sixteen = F.when(F.length(d) <= 8, F.conv(F.concat(F.lit("0"), d), 16, 10).cast("bigint"))
        return let(F.when(is_hex, sixteen).otherwise(decimal), lambda n: F.when(n <= 4294967295, n))

    return let(digits, parsed)


def _decoded(token: Column) -> Column:
    numeric = F.when(token.rlike(NUMERIC), let(_number(token), lambda n: F.when(n.isNotNull(), character(n))))
    bare = F.when(token.rlike(BARE_NAME), named_character(F.concat(token, F.lit(";"))))
    closed = F.endswith(token, F.lit(";"))
    return (
        F.when(~F.startswith(token, F.lit("&")), token)
        .when(closed, F.coalesce(named_character(token), numeric, token))
        .otherwise(F.coalesce(bare, token))
    )


def decode_entities(text: Column | str) -> Column:
    """Decode named and numeric references in one pass from left to right.

    A reference runs to its ``;`` or to white space, ``<`` or the end.  With ``;`` it
    is looked up by name, then read as a number; without, only by name.  What is not
    known stays as it is.  Null stays null.
    """
    value = as_column(text)
    tokens = F.regexp_extract_all(value, F.lit(ENTITY_TOKEN), F.lit(0))
    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(tokens, _decoded), "")).otherwise(value)

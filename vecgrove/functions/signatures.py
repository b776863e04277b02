"""Item signatures for group testing over exclusive-or and inclusive-or channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Index bits that switch the second and third block of an xor signature on.
BLOCK_BITS = (7, 13)


def _bit(j: Column, k) -> Column:
    return F.pmod(F.shiftright(j, k) if isinstance(k, int) else F.floor(j / F.pow(F.lit(2.0), k)).cast("long"), F.lit(2)).cast("int")


def xor_signature(j: Column, bits: int) -> Column:
    """Array of 3 (2 bits + 1) zeros and ones: a parity bit, the index bits and their complements, in up to three blocks."""
    ones = [_bit(j, b) for b in range(bits)]
    block = [F.lit(1), *ones, *[1 - b for b in ones]]
    return F.array(*block, *[x * _bit(j, k) for k in BLOCK_BITS for x in block])


def or_signature(j: Column, bits: int) -> Column:
    """Array of 6 ``bits``: low half of the index, its complement, high half, its complement, and the two differences."""
    low = [_bit(j, b) for b in range(bits)]
    high = [_bit(j, b + bits) for b in range(bits)]
    flip = lambda s: [1 - x for x in s]
    differ = [x.bitwiseXOR(y) for x, y in zip(low, high)]
    return F.array(*low, *flip(low), *high, *flip(high), *differ, *flip(differ))


# -- the same in numpy, for decoders that iterate ------------------------------------------------------------------


def xor_words(items: np.ndarray, bits: int) -> np.ndarray:
    """One row of zeros and ones for each item."""
    j = np.asarray(items, np.int64)[:, None]
    ones = (j >> np.arange(bits)) & 1
    block = np.concatenate((np.ones_like(j), ones, 1 - ones), axis=1)
    return np.concatenate((block, *(block * ((j >> k) & 1) for k in BLOCK_BITS)), axis=1).astype(np.uint8)


def or_words(items: np.ndarray, bits: int) -> np.ndarray:
    j = np.asarray(items, np.int64)[:, None]
    low, high = (j >> np.arange(bits)) & 1, (j >> np.arange(bits, 2 * bits)) & 1
    return np.concatenate((low, 1 - low, high, 1 - high, low ^ high, 1 - (low ^ high)), axis=1).astype(np.uint8)


def read_block(block: np.ndarray) -> int | None:
    """The index that a block of a xor measurement spells, if it can hold exactly one item."""
    bits = (len(block) - 1) // 2
    ones, others = block[1 : 1 + bits], block[1 + bits :]
    if not block[0] or (ones == others).any():
        return None
    return int((ones.astype(np.int64) << np.arange(bits)).sum())


def decode_xor(measured: np.ndarray) -> list[int]:
    """The one or two items whose signatures add up to a measurement; none if it is empty or holds more."""
    size = len(measured) // 3
    bits = (size - 1) // 2
    blocks = measured.reshape(3, size)
    one = read_block(blocks[0])
    if one is not None:
        return [one] if np.array_equal(xor_words([one], bits)[0], measured) else []
    if blocks[0][0]:
        return []
    both = int((blocks[0][1 : 1 + bits].astype(np.int64) << np.arange(bits)).sum())
    for block in blocks[1:] if both else ():
        first = read_block(block)
        if first is not None:
            pair = xor_words([first, first ^ both], bits)
            if np.array_equal(pair[0] ^ pair[1], measured):
                return sorted([first, first ^ both])
    return []


def decode_or(measured: np.ndarray, known: list[int]) -> list[int]:
    """The item that a bucket's inclusive-or measurement shows if it is alone, or those that make it up with one of the ``known``."""
    bits = len(measured) // 6
    low, nlow, high, nhigh = (measured[k * bits : (k + 1) * bits] for k in range(4))
    at = np.arange(bits)
    if not ((low & nlow).any() or (high & nhigh).any()) and ((low | nlow).all() and (high | nhigh).all()):
        item = int((low.astype(np.int64) << at).sum() + (high.astype(np.int64) << (at + bits)).sum())
        return [item] if np.array_equal(or_words([item], bits)[0], measured) else []
    out = set()
    for k in known:
        own = or_words([k], bits)[0]
        # where the known item has no one, a one is the other's; elsewhere the complement tells
        olow, onlow, ohigh, onhigh = (own[n * bits : (n + 1) * bits] for n in range(4))
        first = np.where(olow == 0, low, 1 - nlow)
        second = np.where(ohigh == 0, high, 1 - nhigh)
        other = int((first.astype(np.int64) << at).sum() + (second.astype(np.int64) << (at + bits)).sum())
        if other != k and np.array_equal(own | or_words([other], bits)[0], measured):
            out.add(other)
    return sorted(out)

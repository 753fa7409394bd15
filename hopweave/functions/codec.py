"""Labels packed in one long: edge id from bit 37, hub 24 bits, hop 3, distance 10.

A transport form only; tables keep their columns.  Values that do not fit give
null instead of spilling into their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_AT, HUB_AT, HOP_AT = 37, 13, 10  # fixed values of the format
HUB_BITS, HOP_BITS, DIST_BITS = 24, 3, 10


def pack(edge: Column, hub: Column, hop: Column, dist: Column) -> Column:
    fits = hub.between(0, (1 << HUB_BITS) - 1) & hop.between(0, (1 << HOP_BITS) - 1) & dist.between(0, (1 << DIST_BITS) - 1) & edge.between(0, (1 << 26) - 1)
    long = lambda c: c.cast("long")
    packed = F.shiftleft(long(edge), EDGE_AT).bitwiseOR(F.shiftleft(long(hub), HUB_AT)).bitwiseOR(F.shiftleft(long(hop), HOP_AT)).bitwiseOR(long(dist))
    return F.when(fits, packed)


def unpack(packed: Column) -> dict[str, Column]:
    bits = lambda at, n: F.shiftright(packed, at).bitwiseAND((1 << n) - 1).cast("int")
    return {"edge": bits(EDGE_AT, 26), "hub": bits(HUB_AT, HUB_BITS), "hop": bits(HOP_AT, HOP_BITS), "dist": bits(0, DIST_BITS)}

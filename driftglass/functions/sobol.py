"""Low-discrepancy points as column expressions: point k follows from k alone, so any task can make any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftglass.functions import keyed

BITS = 30
# Published primitive polynomials (degree, inner coefficients) and first direction numbers, from dimension 2 on.
POLYNOMIALS = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)), (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)), (6, 16, (1, 3, 1, 13, 27, 49)),
)
# End of fixed values.
MOST = len(POLYNOMIALS) + 1


def directions(dim: int) -> list[int]:
    """The BITS direction numbers of a dimension (from 0), each as a whole number of 2**-BITS."""
    if dim >= MOST:
        raise ValueError(f"at most {MOST} dimensions")
    if dim == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    degree, inner, first = POLYNOMIALS[dim - 1]
    m = list(first)
    for k in range(degree, BITS):
        new = m[k - degree] ^ (m[k - degree] << degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                new ^= m[k - j] << j
        m.append(new)
    return [x << (BITS - 1 - k) for k, x in enumerate(m)]


def point(k: Column, dim: int, *shift) -> Column:
    """Coordinate `dim` of point k, in (0, 1). shift: parts of a key whose bits are added without carry, the same for all k."""
    gray = k.bitwiseXOR(F.shiftright(k, 1))
    out = keyed.bits(*shift, dim).bitwiseAND((1 << BITS) - 1) if shift else F.lit(0).cast("long")
    for b, v in enumerate(directions(dim)):
        out = out.bitwiseXOR(F.shiftright(gray, b).bitwiseAND(1) * F.lit(v).cast("long"))
    return (out + 0.5) / float(1 << BITS)


def sql_point(k: str, dim: int, *shift: str) -> str:
    """The same in SQL; shift is given as SQL expressions."""
    start = f"(('0x' || substr(md5(concat_ws('|', {', '.join(shift)}, {dim})), 1, 8))::BIGINT & {(1 << BITS) - 1})" if shift else "0::BIGINT"
    for b, v in enumerate(directions(dim)):
        start = f"xor({start}, ((xor({k}, {k} >> 1) >> {b}) & 1) * {v}::BIGINT)"
    return f"(({start} + 0.5::DOUBLE) / {1 << BITS}.0::DOUBLE)"

import random
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa

from lotwise.operators import chain_fractions as cf

UNIT = Decimal("0.000000000001")


def rows(seed, most):
    rng = random.Random(seed)
    for chain in range(60):
        last = rng.choice([None, Decimal(rng.randrange(most)) * UNIT])
        for _ in range(rng.randrange(1, 9)):
            yield chain // 2, chain, last, rng.choice([None, *[Decimal(rng.randrange(10**12 + 1)) * UNIT] * 9])


def test_fractions_equal_decimal_steps_whatever_the_batches():
    for seed, most in ((1, 10**12 + 1), (2, 10**17)):
        table = list(rows(seed, most))
        want, chain, fraction = [], None, None
        for lot, order, last, part in table:
            if (lot, order) != chain:
                chain, fraction = (lot, order), last
            before = fraction
            both = fraction is not None and part is not None
            fraction = (fraction * part).quantize(UNIT, ROUND_HALF_UP) if both else None
            want.append((before, fraction))
        schema = pa.schema([("terminal_lot", pa.int64()), ("order_id", pa.int64()), ("_last", cf.KIND), ("part", cf.KIND)])
        whole = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table), schema)], schema=schema).to_batches()[0]
        for size in (1, 7, 1000):
            parts = [whole.slice(k, size) for k in range(0, len(table), size)]
            got = pa.Table.from_batches(list(cf.add_fractions(iter(parts))))
            assert list(zip(got.column("_fraction").to_pylist(), got.column("fraction").to_pylist())) == want

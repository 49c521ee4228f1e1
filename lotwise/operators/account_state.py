"""The step of an allocation that depends on order: runs in the Python workers.

Rows come sorted by account, day and kind (lots before orders), orders by id. Only
the live lots of the account at hand are kept, as a heap in the order they are sold.
Sizes are whole numbers of their last decimal, so results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

LOT, ORDER = 0, 1  # kinds of rows


class Allocation:
    """Serves the orders of one account after the other."""

    def __init__(self):
        self.account = None
        self.line: list[tuple[int, int, int]] = []  # invest day, lot, what is left
        self.total = 0

    def serve(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(account, order, lot, taken) for rows (account, kind, invest day, id, size); no lot where an order is refused."""
        for account, kind, invested, own_id, size in rows:
            if account != self.account:
                self.account, self.line, self.total = account, [], 0
            if kind == LOT:
                heapq.heappush(self.line, (invested, own_id, size))
                self.total += size
                continue
            wanted = self.total if size is None else size
            if not 0 < wanted <= self.total:
                yield account, own_id, None, None
                continue
            self.total -= wanted
            while wanted:
                invested, lot, left = self.line[0]
                taken = min(left, wanted)
                if taken == left:
                    heapq.heappop(self.line)
                else:
                    heapq.heapreplace(self.line, (invested, lot, left - taken))
                wanted -= taken
                yield account, own_id, lot, taken

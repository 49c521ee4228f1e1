"""State step of the live variation: runs in the Python workers."""

from __future__ import annotations

import pandas as pd

COLUMNS = ["isin", "date", "nav", "previous"]
ARRIVAL = ["arrived", "file"]  # when and in which file a quote came, where that is known


def first_of_days(batches) -> pd.DataFrame:
    """One quote per day, the first that arrived, then the lowest; never more rows than days and one batch."""
    columns = ["date", *ARRIVAL, "nav"]
    kept = pd.DataFrame(columns=columns, dtype=object)
    for batch in batches:
        own = batch.reindex(columns=columns)
        own["arrived"] = pd.to_datetime(own["arrived"]).fillna(pd.Timestamp(0))
        own["file"] = own["file"].fillna("")
        both = pd.concat([kept, own.astype(object)], ignore_index=True)
        kept = both.sort_values(columns).drop_duplicates("date")
    return kept[["date", "nav"]]


def advance(isin, batches, last):
    """New quotes of a fund with the quote before each, and the fund's newest quote after them.

    A quote that is older than the state is ignored.
    """
    quotes = first_of_days(batches)
    if last is not None:
        quotes = quotes[quotes["date"] > last[0]]
    if quotes.empty:
        return pd.DataFrame(columns=COLUMNS), last
    newest = (quotes["date"].iloc[-1], quotes["nav"].iloc[-1])
    rows = quotes.assign(isin=isin, previous=quotes["nav"].shift(1))
    if last is None:
        rows = rows.iloc[1:]
    else:
        rows.iloc[0, rows.columns.get_loc("previous")] = last[1]
    return rows[COLUMNS], newest


def variations(key, batches, state):
    """Grouped state function: the state of a fund is its newest quote."""
    rows, last = advance(key[0], batches, state.get if state.exists else None)
    if last is not None:
        state.update(last)
    yield rows

"""Standings kept per lane in a stream, by the same laws as ``operators.standing.rate_period``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators.standing import DEFAULT, SCALE, new_volatility

SCHEMA = "lane bigint, period bigint, rating double, deviation double, volatility double, events bigint, late bigint"
_STATE = "period bigint, rating double, deviation double, volatility double, information double, gain double, events bigint, late bigint"


def rated(rating: float, deviation: float, volatility: float, information: float, gain: float, tau: float) -> tuple[float, float, float]:
    """A standing after a period with the given sums; without games only the deviation grows."""
    phi = deviation / SCALE
    if information == 0:
        return rating, min(DEFAULT["deviation"], SCALE * math.hypot(phi, volatility)), volatility
    sigma = new_volatility(phi, 1 / information, gain / information, volatility, tau)
    after = 1 / math.sqrt(1 / (phi * phi + sigma * sigma) + information)
    return rating + SCALE * after * after * gain, SCALE * after, sigma


def running_standings(events: DataFrame, tau: float = 0.5) -> DataFrame:
    """Folds events (lane, period, score, opponent_rating, opponent_deviation) into the standing of each lane.

    The state is the standing at the start of the lane's open period and the period's sums so far, so events of one
    period may come in any number of micro-batches; each time the standing as of the open period is given.  An event of
    a later period closes the open one, and idle periods between them are rated as such.  Events of a period that is
    closed can't change it any more: they are counted in ``late``, none is lost unseen.  The opponents' standings are
    those at the period's start, which the events carry.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        period, rating, deviation, volatility, information, gain, count, late = state.get if state.exists else (-1, DEFAULT["rating"], DEFAULT["deviation"], DEFAULT["volatility"], 0.0, 0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["period", "score", "opponent_rating", "opponent_deviation"])
        for each, games in rows.groupby("period"):
            if each < period:
                late += len(games)
                continue
            if each > period:
                if period >= 0:
                    rating, deviation, volatility = rated(rating, deviation, volatility, information, gain, tau)
                    idle = each - period - 1
                    deviation = min(DEFAULT["deviation"], SCALE * math.sqrt((deviation / SCALE) ** 2 + idle * volatility**2)) if idle else deviation
                period, information, gain = int(each), 0.0, 0.0
            phi = games["opponent_deviation"].to_numpy() / SCALE
            weight = 1 / np.sqrt(1 + 3 * phi * phi / math.pi**2)
            e = 1 / (1 + np.exp(-weight * (rating - games["opponent_rating"].to_numpy()) / SCALE))
            information += float((weight * weight * e * (1 - e)).sum())
            gain += float((weight * (games["score"].to_numpy() - e)).sum())
            count += len(games)
        state.update((period, float(rating), float(deviation), float(volatility), information, gain, int(count), int(late)))
        now = rated(rating, deviation, volatility, information, gain, tau)
        yield pd.DataFrame({"lane": [key[0]], "period": [period], "rating": [now[0]], "deviation": [now[1]], "volatility": [now[2]], "events": [count], "late": [late]})

    return events.groupBy("lane").applyInPandasWithState(fold, SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)

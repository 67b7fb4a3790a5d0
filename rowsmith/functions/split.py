"""Row buckets from a hash of the row key: stable under any partitioning of the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FINE = 10_000  # steps within a percent


def key_bucket(key: Column, buckets: int, seed: int | str = 42) -> Column:
    """Bucket number in 0..buckets-1 from the first eight hex digits of an md5 of key and seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def is_holdout(key: Column, share: float = 0.2, seed: int = 42) -> Column:
    """True for the held-out share of rows, in steps of a millionth.

    Whole percents are told by one bucket number; another one divides a percent further.
    """
    place = key_bucket(key, 100, seed) * FINE + key_bucket(key, FINE, f"{seed}|fine")
    return place < int(round(share * 100 * FINE))


def fold_number(key: Column, folds: int = 10, seed: int = 42) -> Column:
    """Fold of a row, from another hash than the one that holds rows out."""
    return key_bucket(key, folds, f"{seed}|fold")


MOST_DRAWN = 500.0  # an expected count beyond this is rounded: drawing it would change it by less than a twentieth


def poisson_draw(expected: Column, u: Column) -> Column:
    """How often a row is drawn: the Poisson count with mean ``expected`` that ``u``, from [0, 1), falls on.

    Counts with means of one row's share of all weight, times the rows, are a weighted sample with replacement.
    The same ``u`` gives the same count again; nothing is expected of a null mean.
    """
    mean = F.least(F.coalesce(expected.cast("double"), F.lit(0.0)), F.lit(MOST_DRAWN))

    @pandas_udf("int")
    def drawn(mean: pd.Series, none: pd.Series, u: pd.Series) -> pd.Series:
        """The number of sums of Poisson terms that ``u`` reaches; ``none`` is the first term. Null for a null ``u``."""
        means, term, place = (v.to_numpy(float) for v in (mean, none, u))
        upto, n = term, np.zeros(len(means), np.int32)
        most = np.ceil(means + 12 * np.sqrt(means) + 20)
        step, reached = 1, place >= upto
        while reached.any():
            n += reached
            term = term * means / step
            upto = upto + term
            step += 1
            reached = reached & (place >= upto) & (step <= most)
        return pd.Series(n).astype("Int32").mask(np.isnan(place))

    return F.when(expected > MOST_DRAWN, F.round(expected).cast("int")).otherwise(drawn(mean, F.exp(-mean), u))
